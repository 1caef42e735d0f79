import base64

import numpy as np
import pytest
import tiktoken

from wattlink.llm import token_counts as T

TEXTS = [None, "", "Hello, world!", "  blanks  and\n\nlines ", "é漢🙂" * 40, "<|endoftext|>", "x" * 3000, "it's 1234"]


def counts():
    with open(T.DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(e.encode_ordinary(t or "")) for t in TEXTS]


@pytest.mark.parametrize("block", [4_000_000, 64, 7, 1])
def test_counts_match_the_tokenizer_across_blocks(spark, block):
    ids = [0, 50256, -1, 2**62 + 5, -(2**63), None, 32767, 12]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, TEXTS)] + [(0, None, 2)], "doc_id long, text string, n_tokens int").coalesce(2)
    path = T.write(docs)
    got = T.scan(spark, path, block_tokens=block).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted([*zip(ids, counts()), (0, 0)], key=str)
    assert all(r["terminated"] for r in got)
    for file in {r["file"] for r in got}:
        own = sorted(r["ordinal"] for r in got if r["file"] == file)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("block", [100, 3])
def test_plain_flat_files(spark, tmp_path, block):
    for name, ids in (("a", [9, 1, 2, 9, 9, 3, 4, 5]), ("b", [9]), ("c", []), ("d", [7, 7, 9])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes() + (b"x" if name == "d" else b""))
    got = T.scan(spark, str(tmp_path), separator=9, preamble=False, block_tokens=block).collect()
    rows = sorted((r["file"][-1], r["ordinal"], r["first"], r["n_tokens"], r["terminated"]) for r in got)
    assert rows == [("a", 0, 0, 0, True), ("a", 1, 1, 2, True), ("a", 2, 4, 0, True), ("a", 3, 5, 3, False), ("b", 0, 0, 0, True), ("d", 0, 0, 2, True)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.scan(spark, T.write(docs)).count() == 0

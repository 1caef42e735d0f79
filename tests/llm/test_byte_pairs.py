import hashlib
import random
import time

import duckdb
import pytest
from tokenizers import Tokenizer

from wattlink.llm import byte_pairs as B
from wattlink.llm.queries import op12_byte_pairs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bpe():
    return B.Bpe.load()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(B.DEFAULT_FILE)
    t.no_truncation()
    t.no_padding()
    return t


def same(bpe, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [i.tolist() for i in bpe.encode(texts)]
    assert got == want
    for t, ids in zip(texts, bpe.encode(texts)):
        assert bpe.decode(ids).decode("utf-8", "replace") == t == library.decode(ids.tolist(), skip_special_tokens=False)


def test_every_character(bpe, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 64):  # beside letters, numbers, signs and blanks of every kind
        text = "".join(f"x{c}1{c}. {c}\n{c}" for c in chars[k:k + 64])
        assert bpe.pretokens(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
    same(bpe, library, ["a" + c + "1" + c + "!" + c + " " + c for c in chars[::97]])


def test_random_texts(bpe, library):
    rng = random.Random(5)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'LL", "é", "一", "二", "😀", "1", "23", "٣", ".", "--", "　", "\x85",
             "\x00", "<|endoftext|>", "<|endof", "|>", "é", "ſ", "ing", "tion"]
    same(bpe, library, ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", "<|endoftext|>"])


def test_given_texts(bpe, library):
    same(bpe, library, [t for t, in duckdb.sql(f"SELECT text FROM read_parquet('{DATA}/documents.parquet') WHERE text IS NOT NULL").fetchall()])


def test_long_pretokens(bpe, library):
    rng = random.Random(2)
    texts = ["a" * 200_000, "".join(rng.choice("etaoinshr") for _ in range(300_000)), "。" * 50_000, " " * 100_000]
    start = time.time()
    got = [i.tolist() for i in bpe.encode(texts)]
    assert time.time() - start < 30 and bpe._memory is None
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_memory_starts_over(bpe, monkeypatch):
    texts = ["one two three four five", "six seven", "one two"]
    want = [i.tolist() for i in bpe.encode(texts)]
    monkeypatch.setattr(B, "REMEMBERED", 2)
    assert [bpe.encode([t])[0].tolist() for t in texts] == want


def test_bytes_that_are_no_text(bpe):
    half = bpe.encode(["é"])[0]
    raw = [bpe.byte_ids[0xC3]]
    assert bpe.decode(half).decode() == "é"
    import numpy as np
    assert bpe.decode(np.array(raw)).decode("utf-8", "replace") == "�"


def test_query(spark, library, tmp_path):
    rows = [(1, "Hello  world's 12 <|endoftext|> x\n"), (1, None), (None, ""), (2, "naïve 😀 一二三"), (2, "naïve 😀 一二三")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS ids", "2 AS decoded").repartition(2).write.parquet(
        str(tmp_path / "documents.parquet"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in op12_byte_pairs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_operator_passes_columns(spark, bpe):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, None)], "row long, text string, taken string")
    got = B.decoded(B.encoded(docs, bpe), bpe)
    assert got.columns == ["row", "text", "taken", "ids", "decoded"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(1, "a b", "x", [64, 275], "a b"), (None, None, None, [], "")]
    assert B.encoded(docs.where("false"), bpe).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        B.Bpe.load("/opt/tokenizers/word_bpe_49k.json")

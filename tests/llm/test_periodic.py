import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wattlink.llm import periodic as P
from wattlink.llm.queries import op11_periodic_runs, with_periodic_tails

DATA = "/root/testdata/sf0.001"


def brute(words):
    """start, length, period of every run, by comparing words p apart for every p."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            begin = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - begin + p
            part = words[begin:begin + length]
            smaller = any(part[d:] == part[:-d] for d in range(1, p) if p % d == 0)
            if length >= max(6, 4 * p) and not smaller:
                out.append((begin, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_match_brute_force():
    rng = random.Random(1)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], list("aabaabaabaabaab"), list("abcabcabcabcx")]
    for k in range(400):
        alphabet = "ab" if k % 3 else "abcdefgh"
        words = []
        while len(words) < rng.randrange(1, 90):
            unit = [rng.choice(alphabet) for _ in range(rng.randrange(1, 6))]
            words += unit * rng.choice([1, 1, 2, 4, 5, 7]) + unit[:rng.randrange(len(unit))]
        texts.append(words)
    got = P.runs_of(texts)
    want = [brute(w) for w in texts]
    assert got == want and sum(map(len, want)) > 300 and max(map(len, want)) > 3
    assert [P.runs_of([w])[0] for w in texts[:40]] == want[:40]


def test_nested_runs_and_long_texts():
    inner = ["x"] * 7 + ["y"]
    words = ["p", "q"] + inner * 5 + ["z"]
    assert P.runs_of([words])[0] == brute(words) and len(brute(words)) == 6
    many = ["a"] * 60_000 + ["b"] + [str(k % 50) for k in range(40_000)]
    assert P.runs_of([many])[0] == [(0, 60_000, 1), (60_001, 40_000, 50)]
    assert len(P.collapsed(many, P.runs_of([many])[0])) == 52


def test_strongest():
    assert P.strongest([]) is None
    assert P.strongest([(5, 8, 2), (1, 12, 3), (9, 4, 1)]) == (1, 12, 3)
    # 10^9 + 1 to 10^9 is told from 1 to 1
    assert P.strongest([(0, 4 * 10**17, 10**17), (1, 4 * 10**17 + 1, 10**17)]) == (1, 4 * 10**17 + 1, 10**17)


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = P.strongest(runs)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_on_given_texts(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{DATA}/documents.parquet') WHERE length(text) < 3000").fetchall()
    got = {r["doc_id"]: tuple(r) for r in op11_periodic_runs(spark, DATA).collect()}
    assert len(docs) > 150
    for doc_id, text in docs:
        assert got[doc_id] == expected(doc_id, text)
    assert sum(1 for r in got.values() if r[1]) >= 10


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "a b a b a b a b", "é　x é　x"])
def test_odd_texts(spark, tmp_path, text):
    rows = [(i, text) for i in (None, 3, 3, 17, 25, 38, 45)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)


def test_tails(spark):
    words = [f"w{k}" for k in range(40)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(words[:n])) for i in ids for n in (1, 2, 3, 17, 40)]
    got = {(r["doc_id"], r["text"]) for r in with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, " ".join(planted(i, t.split()))) for i, t in rows}

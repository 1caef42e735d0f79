import random
import re

import xxhash
from pyspark.sql import functions as F

from wattlink.llm import simhash as S


def by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    names = {}
    for i, d in enumerate(ids):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return [names.get(find(i)) for i in range(len(ids))]


def test_fingerprints_and_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", " \n", "One", "one two", "Eins zwei drei", "ÄB äb É", "a  b\tc\nd"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([5, 40, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    ids = [i * 3 for i in range(len(texts))]
    ids[3] = None
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, fp string")
    got = S.near_duplicates(docs).collect()
    prints = [by_hand(t) for t in texts]
    want = sorted(zip(ids, [f"{p:016x}" for p in prints], brute_components(ids, prints)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    kept = [r["doc_id"] for r in S.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted({c for _, _, c in want if c is not None} | {None}, key=str)


def test_crowded_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "BALL_FROM", 4)
    rng = random.Random(2)
    base, prints = rng.getrandbits(64), set()
    for _ in range(150):
        v = base
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        prints.add(v)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {tuple(sorted((r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)))) for r in S.links(frame).collect()}
    listed = sorted(prints)
    want = {(x, y) for i, x in enumerate(listed) for y in listed[i + 1:] if (x ^ y).bit_count() <= 2}
    assert got == want and len(want) > 50


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in S.components(edges).collect()} == {0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.keep_first(docs).count() == 0

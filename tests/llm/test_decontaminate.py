import random
import re

from pyspark.sql import functions as F

from wattlink.llm import decontaminate as D


def shingles(text, length):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, set(zip(*[w[k:] for k in range(length)]))


def brute(docs, items):
    out = []
    for item_id, t in items:
        n = len(shingles(t, 1)[0])
        if not n:
            continue
        own = shingles(t, min(n, 5))[1]
        for doc_id, text in docs:
            shared = len(own & shingles(text, min(n, 5))[1])
            if shared * 10 >= 8 * len(own):
                out.append((doc_id, item_id, shared, len(own)))
    return sorted(out)


def fixture():
    rng = random.Random(3)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 5, 6, 9, 24, 25, 40, 120]))) for i in range(60)] + [(60, ""), (61, None), (62, items_twice := say(30)), (63, items_twice)]
    docs = []
    for i in range(120):
        parts = [say(rng.choice([3, 50, 400]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = "other"
            parts += [" ".join(w).upper().replace("É", "é").replace(" ", ", "), say(4)]
        docs.append((i, " ".join(parts)))
    return docs + [(200, None), (201, ""), (202, docs[5][1])], items


def test_matches_equal_brute_force_in_one_and_in_many_blocks(spark, monkeypatch):
    docs, items = fixture()
    want = brute(docs, items)
    assert len(want) > 40
    d = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.matches(d, b)
    assert sorted(tuple(r)[:4] for r in got.collect()) == want
    monkeypatch.setattr(D.item_blocks, "__defaults__", (200,))
    assert sorted(tuple(r)[:4] for r in D.matches(d, b).collect()) == want
    dirty = {w[0] for w in want}
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in dirty)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert D.matches(docs.limit(0), items).count() == 0
    assert D.matches(docs, items.limit(0)).count() == 0
    assert D.drop_contaminated(docs, items.limit(0)).count() == 1
    assert D.matches(docs, items).select(F.max("containment")).first()[0] == 1.0

import math
import random

import pytest
from pyspark.sql import functions as F

from wattlink.llm import hard_negatives as H
from wattlink.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, low=30, high=90):
    """Every row of every anchor, sorted whole. Rows are told apart by their place."""
    usable = []
    for place, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label, place))
    out = []
    for i, v, label, place in usable:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m == label) for j, w, m, p in usable if p != place)
        for s, j, same in [x for x in scored if x[2]][:5]:
            fits = [(t, k) for t, k, same2 in scored if not same2 and low * -s <= 100 * -t <= high * -s][:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).select("*", F.lit(0).alias("rid"), F.lit(0).alias("score"), F.lit(0).alias("g")).repartition(3).write.parquet(
        str(tmp_path / "embeddings.parquet"))
    out = op13_hard_negatives(spark, str(tmp_path))
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                                "positive_score": "bigint", "negative_score": "bigint"}
    return sorted(tuple(r) for r in out.collect())


def vector(rng, n=8):
    x = [rng.gauss(0, 1) for _ in range(n)]
    size = math.sqrt(sum(a * a for a in x))
    return [a / size for a in x]


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_matches_brute_force(spark, tmp_path, monkeypatch, pairs):
    monkeypatch.setattr(H, "PAIRS", pairs)
    rng = random.Random(4)
    rows = [(i, vector(rng), rng.randrange(10)) for i in range(0, 1500, 2)]
    want = brute(rows)
    assert len(want) > 300 and mined(spark, tmp_path, rows) == want


def test_ties_and_repeated_rows(spark, tmp_path):
    rng = random.Random(6)
    few = [vector(rng, 3) for _ in range(15)]
    rows = [(i, few[rng.randrange(15)], rng.randrange(3)) for i in range(300)]
    rows += [(100, few[0], 1)] * 2 + [(250, few[1], 2)] * 30  # one vector holds many rows, one id several
    want = brute(rows)
    assert len(want) > 50 and mined(spark, tmp_path, rows) == want


def test_odd_rows(spark, tmp_path):
    good = [1.0, 0.5]
    rows = [(0, good, 1), (1, good, 1), (2, [0.4, 0.4], 2), (3, None, 1), (4, good, None), (None, good, 1), (5, [float("nan"), 1.0], 2),
            (6, [float("inf"), 1.0], 2), (8, [None, 1.0], 2), (9, [0.5], 2), (10, [], 2), (100, [], 3), (200, [-1.0, -1.0], 1), (300, [0.0, 0.0], 5),
            (11, [0.0, 0.0], 5), (-100, [1.0, 0.25], 2), (-7, good, 9)]
    want = brute([(i, v and v + [0.0] * (2 - len(v)) if v is not None else None, m) for i, v, m in rows])
    assert want and mined(spark, tmp_path, rows) == want


def test_empty_table(spark, tmp_path):
    assert mined(spark, tmp_path, []) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1 << 28, 1], 0), (1, [1 << 28, 2], 0), (2, [1 << 27, 3], 1), (3, [1 << 27, 4], 1)]
    df = spark.createDataFrame([(i, m, v) for i, v, m in rows], "id long, label long, v array<long>")
    got = [tuple(r) for r in H.mined(df, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3, (1 << 56) + 2, (1 << 55) + 4), (0, 1, 2, 2, (1 << 56) + 2, (1 << 55) + 3)]

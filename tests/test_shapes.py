"""Hulls and polygons against plain implementations."""

import random

import pytest
from pyspark.sql import functions as F

from wattlink.operators import hull, polygons, views

POINT = "id long, lng double, lat double"


def run(spark, farms, points, links, partial=True):
    f = spark.createDataFrame(farms, POINT)
    p = spark.createDataFrame(points, POINT)
    l = spark.createDataFrame(links, "farm_id long, recognition_id long")
    rows = hull.farm_hulls(f, l, p, partial).collect()
    return {r["farm_id"]: [(v["lng"], v["lat"]) for v in r["boundary"]] for r in rows}


@pytest.mark.parametrize("partial", [True, False])
def test_small_hulls(spark, partial):
    farms = [(1, 5.0, 5.0), (2, 9.0, 1.0), (3, 0.0, 0.0), (4, 7.0, 7.0), (5, 0.5, 0.5)]
    points = [(10, 1.0, 1.0), (11, 1.0, 1.0), (12, 2.0, 2.0), (13, 7.0, 7.0), (14, 7.0, 7.0),
              (15, 0.0, 0.0), (16, 1.0, 0.0), (17, 1.0, 1.0), (18, 0.0, 1.0)]
    links = [(2, 10), (3, 11), (3, 12), (4, 13), (4, 14), (5, 15), (5, 16), (5, 17), (5, 18)]
    got = run(spark, farms, points, links, partial)
    assert got[1] == [(5.0, 5.0)]
    assert got[2] == [(9.0, 1.0), (1.0, 1.0)]  # two points stay as they are, the farm first
    assert got[3] == [(0.0, 0.0), (2.0, 2.0)]  # on one line: the ends
    assert got[4] == [(7.0, 7.0), (7.0, 7.0)]  # one position three times
    assert got[5] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]


def test_hot_farm_equals_direct_hull(spark):
    rng = random.Random(2)
    points = [(i, rng.randrange(3000) / 1e4, rng.randrange(3000) / 1e4) for i in range(30_000)]
    points += [(30_000 + i, 0.15, 0.15) for i in range(500)]
    links = [(1 if rng.random() < 0.6 else rng.randrange(2, 300), p[0]) for p in points]
    farms = [(i, 0.1, 0.1) for i in range(1, 300)]
    got = run(spark, farms, points, links)
    assert got == run(spark, farms, points, links, partial=False)
    where = {p[0]: p[1:] for p in points}
    for farm in (1, 7, 120):
        mine = [(0.1, 0.1)] + [where[r] for f, r in links if f == farm]
        assert got[farm] == hull.convex_hull(mine)


def test_partial_hulls_shrink(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    xy = rng.normal(size=(20_000, 2))
    outer = hull.outer_points(xy)
    assert len(outer) < 100
    assert hull.convex_hull(list(map(tuple, outer.tolist()))) == hull.convex_hull(list(map(tuple, xy.tolist())))


def even_odd(x, y, ring):
    inside, j = False, len(ring) - 1
    for i in range(len(ring)):
        (xi, yi), (xj, yj) = ring[i], ring[j]
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            inside = not inside
        j = i
    return inside


@pytest.mark.parametrize("cell", [0.5, 0.3, 7.0])
def test_points_in_polygons(spark, cell):
    rng = random.Random(4)
    rings = {i: [(rng.uniform(-3, 3) + i, rng.uniform(-3, 3)) for _ in range(rng.randrange(3, 12))] for i in range(12)}
    rings[20] = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rings[21] = [(0.0, 0.0), (1.0, 1.0)]
    points = [(i, rng.uniform(-4, 14), rng.uniform(-4, 4)) for i in range(800)]
    points += [(900 + i, x, y) for i, (x, y) in enumerate([(0.5, 0.5), (1.5, 0.5), (0.0, 0.0), (1.0, 1.0), (0.5, 0.0), (0.5, 1.0)])]
    p = spark.createDataFrame(points, POINT)
    g = spark.createDataFrame(
        [(k, [{"lng": x, "lat": y} for x, y in r]) for k, r in rings.items()],
        "polygon_id long, ring array<struct<lng:double,lat:double>>")
    got = {tuple(r) for r in polygons.points_in_polygons(p, g, cell).collect()}
    want = {(i, k) for i, x, y in points for k, r in rings.items() if len(r) >= 3 and even_odd(x, y, r)}
    assert got == want


def test_outer_rings(spark):
    body = ('{"features":[{"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4.5],[5,6]],[[0,0]]]}},'
            '{"geometry":{"type":"MultiPolygon","coordinates":[[[[1,1],[2,2]]],[[]],[[[9,9],[8,8]],[[7,7]]]]}},'
            '{"geometry":{"type":"Point","coordinates":[1,2]}},{"geometry":null}]}')
    df = spark.createDataFrame([(body,), ("broken",)], "body string")
    rings = [[tuple(v) for v in r["ring"]] for r in polygons.outer_rings(df).orderBy("feature_no", "ring_no").collect()]
    assert rings == [[(1.0, 2.0), (3.0, 4.5), (5.0, 6.0)], [(1.0, 1.0), (2.0, 2.0)], [(9.0, 9.0), (8.0, 8.0)]]


def test_locale_order(spark):
    df = spark.createDataFrame([(t,) for t in ("太阳能发电", "水电", "风电", "火电")], "power_type string")
    assert [r[0] for r in views.in_locale_order(df).collect()] == ["风电", "火电", "水电", "太阳能发电"]

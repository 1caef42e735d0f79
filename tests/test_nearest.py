"""Nearest-neighbour and containment joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wattlink.operators import association as A, containment, nearest


def km(a, b):
    rad = lambda v: v * math.pi / 180
    h = math.sin(rad(b[1] - a[1]) / 2) ** 2 + math.cos(rad(a[1])) * math.cos(rad(b[1])) * math.sin(rad(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h)) if h <= 1 else math.nan


def brute(points, sites, radius, match=lambda p, s: True):
    out = {}
    for p in points:
        best = None
        for s in sorted(sites, key=lambda s: (s[1], s[0])):
            d = km((p[1], p[2]), (s[2], s[3]))
            if match(p, s) and d <= radius and (best is None or d < best[1]):
                best = (s[0], d)
        if best:
            out[p[0]] = best[0]
    return out


def frames(spark, points, sites):
    p = spark.createDataFrame([q[:3] for q in points], "id long, lng double, lat double")
    s = spark.createDataFrame([q[:4] for q in sites], "id long, name string, lng double, lat double")
    return p, s


def found(df):
    rows = df.collect()
    out = {r["id"]: r["s_id"] for r in rows}
    assert len(out) == len(rows)
    return out


def scatter(rng, n, lng, lat, spread):
    return [(lng + rng.uniform(-spread, spread), lat + rng.uniform(-spread, spread)) for _ in range(n)]


def places(rng):
    """Scattered positions, poles, antimeridian, impossible latitudes, and a crowded spot."""
    out = scatter(rng, 150, 102, 25, 0.5) + scatter(rng, 30, 179.99, 10, 0.2) + scatter(rng, 30, -179.99, 10, 0.2)
    out += [(rng.uniform(-180, 180), rng.choice([-1, 1]) * (90 - rng.uniform(0, 0.2))) for _ in range(40)]
    out += [(rng.uniform(-180, 180), 90 + rng.uniform(0, 0.2)) for _ in range(20)]
    out += scatter(rng, 60, 102.2, 25.2, 1e-4) + [(102.2, 25.2)] * 60 + [(0.0, 0.0)] * 20
    return out


@pytest.fixture(params=[1, 2])
def case(request):
    rng = random.Random(request.param)
    points = [(i, *xy) for i, xy in enumerate(places(rng))]
    sites = [(i, f"n{rng.randrange(400):03d}", *xy) for i, xy in enumerate(places(rng))]
    return points, sites


@pytest.mark.parametrize("radius", [0.0, 0.05, 10.0, 400.0, 30000.0])
def test_radius_join(spark, case, radius):
    points, sites = case
    p, s = frames(spark, points, sites)
    want = brute(points, sites, radius)
    for strategy in ("broadcast", "shuffle"):
        assert found(nearest.nearest_within(p, s, radius, strategy)) == want


@pytest.mark.parametrize("radius", [10.0, 400.0])
def test_crowded_cells_descend(spark, case, radius, monkeypatch):
    """Cells with many sites go through the descending grid, with the same result."""
    monkeypatch.setattr(nearest, "DIRECT_SITES", 6)
    monkeypatch.setattr(nearest, "LEAF_SITES", 3)
    points, sites = case
    p, s = frames(spark, points, sites)
    assert found(nearest.nearest_within(p, s, radius)) == brute(points, sites, radius)


@pytest.mark.parametrize("radius", [10.0])
def test_dense_sites_are_met_as_short_lists(spark, radius, monkeypatch):
    """Where sites lie densely, a point meets one list and is not carried down a grid."""
    monkeypatch.setattr(nearest, "DIRECT_SITES", 30)
    descend, carried = nearest._descend, []

    def counted(probes, *rest):
        carried.append(probes.count())
        return descend(probes, *rest)

    monkeypatch.setattr(nearest, "_descend", counted)
    rng = random.Random(7)
    points = [(i, *xy) for i, xy in enumerate(scatter(rng, 300, 102.0, 25.0, 0.4))]
    sites = [(i, f"n{i % 90:03d}", *xy) for i, xy in enumerate(scatter(rng, 900, 102.0, 25.0, 0.45))]
    p, s = frames(spark, points, sites)
    assert found(nearest.nearest_within(p, s, radius)) == brute(points, sites, radius)
    grouped = nearest.nearest_in_groups(p.withColumn("g", F.lit("a")), s.withColumn("g", F.lit("a")), ["id", "lng", "lat"])
    assert found(grouped) == brute(points, sites, 1e9)
    assert sum(carried) < 30  # of 300 points, asked twice


def test_crowded_parts_and_pieces_of_lists(spark, monkeypatch):
    """Many probes of one cell in several parts, a list in several rows, few products at once: same result, one pair a probe."""
    for name, value in (("DEALT", 7), ("LISTED", 3), ("MET", 50), ("CELL_SITES", 20)):
        monkeypatch.setattr(nearest, name, value)
    met, pairs = nearest._met, []

    def counted(*args):
        pairs.append(met(*args))
        return pairs[-1]

    monkeypatch.setattr(nearest, "_met", counted)
    rng = random.Random(8)
    points = [(i, *xy) for i, xy in enumerate(scatter(rng, 300, 102.0, 25.0, 1e-2) + scatter(rng, 200, 102.0, 25.0, 0.4))]
    sites = [(i, f"n{i % 90:03d}", *xy) for i, xy in enumerate(scatter(rng, 700, 102.0, 25.0, 0.45))]
    p, s = frames(spark, points, sites)
    for strategy in ("auto", "shuffle"):
        assert found(nearest.nearest_within(p, s, 10.0, strategy)) == brute(points, sites, 10.0)
    assert len(pairs) == 2 and all(df.count() <= 500 for df in pairs)


def test_a_site_is_listed_in_few_cells(spark, monkeypatch):
    """Lists leave out sites that are farther from all probes of a cell than one of its own: as dense sites grow, so do the lists."""
    monkeypatch.setattr(nearest, "CELL_SITES", 60)
    met, listed = nearest._met, []

    def counted(probes, lists, *rest):
        listed.append(lists.agg(F.sum(F.size("sites"))).first()[0])
        return met(probes, lists, *rest)

    monkeypatch.setattr(nearest, "_met", counted)
    rng = random.Random(9)
    points = [(i, *xy) for i, xy in enumerate(scatter(rng, 600, 102.0, 25.0, 0.4))]
    for n in (250, 1000):
        sites = [(i, f"n{i % 90:03d}", *xy) for i, xy in enumerate(scatter(rng, n, 102.0, 25.0, 0.4))]
        p, s = frames(spark, points, sites)
        assert found(nearest.nearest_within(p, s, 10.0)) == brute(points, sites, 10.0)
        assert listed.pop() <= 8 * n


def test_plans_do_not_grow_with_levels(spark, monkeypatch):
    """The driver plans one join for the lists, or leaves, of all levels, and the cells of all levels share the bytes of one broadcast."""
    monkeypatch.setattr(nearest, "DIRECT_SITES", 8)
    closest, joins = nearest._closest_in_cells, {}
    planned = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join ")

    def counted(assigned, *rest, **more):
        out = closest(assigned, *rest, **more)
        joins[assigned.where("level IS NOT NULL").select("level").distinct().count()] = planned(out)
        return out

    monkeypatch.setattr(nearest, "_closest_in_cells", counted)
    rng = random.Random(12)
    spots = lambda n: [xy for wide in (0.4, 0.04, 0.004) for xy in scatter(rng, n, 102.0, 25.0, wide)]
    points = [(i, *xy) for i, xy in enumerate(spots(100))]
    sites = [(i, f"n{i % 90:03d}", *xy) for i, xy in enumerate(spots(200))]
    p, s = (df.withColumn("g", F.lit("a")) for df in frames(spark, points, sites))
    for halvings in (1, 6):
        monkeypatch.setattr(nearest, "HALVINGS", halvings)
        assert found(nearest.nearest_in_groups(p, s, ["id", "lng", "lat"])) == brute(points, sites, 1e9)
    assert min(joins) == 1 and max(joins) >= 3 and len(set(joins.values())) == 1

    cells = nearest._short_cells(s, 0.02, None)
    sizes = [known.count() * 33 for _, known, _ in cells]
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", max(sizes))
    small = [fits for _, _, fits in nearest._short_cells(s, 0.02, None)]
    assert len(sizes) > 2 and any(small) and sum(n for n, fits in zip(sizes, small) if fits) <= max(sizes)

    leaves = []
    for most in (1000, 4):
        monkeypatch.setattr(nearest, "LEAF_SITES", most)
        leaves.append(planned(nearest._descend(p, s, ["id", "lng", "lat"], None, 4.0)))
    assert leaves == [1, 1]


def test_unusable_radius(spark, case):
    p, s = frames(spark, *case)
    for radius in (math.nan, -1.0, None):
        assert nearest.nearest_within(p, s, radius).count() == 0


def test_hot_cluster_pair(spark, monkeypatch):
    """Two tight clusters far from each other: candidates stay few per point."""
    monkeypatch.setattr(nearest, "DIRECT_SITES", 32)
    monkeypatch.setattr(nearest, "LEAF_SITES", 8)
    rng = random.Random(5)
    points = [(i, *xy) for i, xy in enumerate(scatter(rng, 400, 102.0, 25.0, 1e-3))]
    sites = [(i, f"n{i}", *xy) for i, xy in enumerate(scatter(rng, 600, 102.04, 25.0, 1e-3))]
    p, s = frames(spark, points, sites)
    probes = p.select("lng", "lat", F.lit(1).alias("g")).distinct()
    pairs = nearest._descend(probes, s.withColumn("g", F.lit(1)), ["lng", "lat"], 10.0, 4.0)
    assert pairs.count() < 400 * 100  # of 240,000
    assert found(nearest.nearest_within(p, s, 10.0)) == brute(points, sites, 10.0)


@pytest.mark.parametrize("limit", [containment.BROADCAST_BYTES, 0])
def test_containing_pairs(spark, limit, monkeypatch):
    monkeypatch.setattr(containment, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("云南省昆a😀") for _ in range(n))
    needles = sorted({word(rng.randrange(1, 6)) for _ in range(200)})
    hays = sorted({word(rng.randrange(1, 14)) for _ in range(200)} | {"云云云云云"})
    n = spark.createDataFrame([(w,) for w in needles], "needle string")
    h = spark.createDataFrame([(w,) for w in hays], "hay string")
    rows = [tuple(r) for r in containment.containing_pairs(n, h).collect()]
    assert sorted(rows) == sorted((a, b) for a in needles for b in hays if a in b)


def test_long_texts_make_few_rows(spark, monkeypatch):
    """Rows made for a text are at most its characters a q-gram size, and a text meets a needle by its rarest q-gram only."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    needles = [text[i:i + n] for i in range(0, 4000, 40) for n in (8, 30, 200)] + ["zzz" + text[:5]]
    n, h = spark.createDataFrame([(w,) for w in needles], "n string"), spark.createDataFrame([(text,), (text[:50],)], "h string")
    assert containment.containing_pairs(n, h, "n", "h").count() == sum(w in t for w in needles for t in (text, text[:50]))
    listed = n.select("n", F.explode(containment._grams(F.col("n"), F.lit(3))).alias("gram"))
    held = h.select("h", F.explode(containment._grams(F.col("h"), F.lit(3))).alias("gram"))
    assert held.count() <= 5050
    rare = containment.rarest_grams(listed, held, "n").collect()
    assert len(rare) == len({*needles}) - 1 and all(r["texts"] <= 2 for r in rare)


@pytest.mark.parametrize("direct", [256, 4])
def test_poi_links(spark, direct, monkeypatch):
    """Hot addresses and hot place names, both ways of containment, against brute force."""
    monkeypatch.setattr(nearest, "DIRECT_SITES", direct)
    monkeypatch.setattr(nearest, "LEAF_SITES", 2)
    rng = random.Random(11)
    texts = ["云南", "云南省", "云 南省（昆明）", "昆", "昆明-市", "", None, "省昆明市东", "大理", "😀"]
    addresses = [(i, f"f{rng.randrange(99):02d}", rng.uniform(100, 103), rng.uniform(24, 26), rng.choice(texts + ["云南"] * 5))
                 for i in range(120)]
    pois = [(i, rng.uniform(100, 103), rng.uniform(24, 26), rng.choice(texts + ["云南省昆明市"] * 5)) for i in range(150)]
    f = spark.createDataFrame(addresses, "id long, enterprise_name string, lng double, lat double, raw_address string")
    p = spark.createDataFrame(pois, "id long, lng double, lat double, poi string")

    def plain(t):
        return "".join(c for c in (t or "") if not c.isspace() and c not in "()（）_-—,，。.、")

    def match(point, site):
        a, b = plain(site[4]), plain(point[3])
        size = lambda t: len(t.encode("utf-16-be")) // 2
        return size(a) >= 2 and size(b) >= 2 and (a in b or b in a)

    got = {r["recognition_id"]: r["farm_id"] for r in A.poi_links(f, p).collect()}
    assert got == brute(pois, addresses, math.inf, match)

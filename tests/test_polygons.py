"""Points in polygons over a quadtree cover, against the plain even-odd rule."""

import math
import random

import pytest

from wattlink.operators import polygons as P


def inside(lng, lat, ring):
    hit = False
    for (xi, yi), (xj, yj) in zip(ring, ring[-1:] + ring[:-1]):
        if (yi > lat) != (yj > lat) and lng < (xj - xi) * (lat - yi) / (yj - yi) + xi:
            hit = not hit
    return hit


def star(rng, n, width):
    x, y = rng.uniform(-120, 120), rng.uniform(-50, 50)
    return [(x + width * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), y + width * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n))
            for k in range(n)]


def frame(spark, rings):
    return spark.createDataFrame([(k, [tuple(map(float, p)) for p in r]) for k, r in enumerate(rings)],
                                 "polygon_id int, ring array<struct<lng: double, lat: double>>")


def test_equal_to_the_even_odd_rule(spark):
    rng = random.Random(7)
    rings = [star(rng, rng.randrange(3, 40), w) for w in (0.1, 0.4, 2, 9, 30, 60) for _ in range(2)]
    rings += [[(-10, -10), (10, -10), (10, 10), (-10, 10)], [(0, 0), (1, 1)], [], [(5, 5), (6, 6), (7, 7)],
              [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)]]
    spots = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(400)]
    spots += [(x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for r in rings for x, y in r[:20]]
    spots += [(x / 2, y / 2) for x in range(-22, 23) for y in range(-22, 23)]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)], "id int, lng double, lat double")
    got = sorted(tuple(r) for r in P.points_in_polygons(points, frame(spark, rings)).collect())
    assert got == sorted((k, n) for k, (x, y) in enumerate(spots) for n, r in enumerate(rings) if inside(x, y, r))
    assert P.points_in_polygons(points, frame(spark, rings).limit(0)).count() == 0


@pytest.mark.parametrize("width", [16, 64])
def test_cells_grow_with_the_outline(spark, width):
    square = [(0.1, 0.1), (width + 0.1, 0.1), (width + 0.1, width + 0.1), (0.1, width + 0.1)]
    cells = P.cover(frame(spark, [square])).collect()
    assert len(cells) < 5 * 4 * width / P.CELL_DEGREES < (width / P.CELL_DEGREES) ** 2 * 2
    assert any(c["inner"] and c["level"] > 1 for c in cells) and all(not c["edges"] for c in cells if c["inner"])

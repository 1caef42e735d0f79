"""Convex hull per farm. Partial hulls shrink the data ahead of the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SCHEMA = "farm_id long, n long, seq long, lng double, lat double"
HOLD = 10_000     # rows of one farm held before they are shrunk
SALTS = 16        # tasks that shrink a hot farm before its last one
SHRINK_FROM = 16  # a farm with fewer rows in a batch is sent on as it is


def _chain(points: list[tuple[float, float]], margin: float) -> list[tuple[float, float]]:
    """One side of the hull over sorted points. A point is dropped when the turn at it is not
    counter-clockwise (margin 0) or clockwise by more than the margin."""
    side: list[tuple[float, float]] = []
    for px, py in points:
        while len(side) >= 2:
            (ox, oy), (ax, ay) = side[-2], side[-1]
            if (ax - ox) * (py - oy) - (ay - oy) * (px - ox) > -margin:
                break
            side.pop()
        side.append((px, py))
    return side


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise hull from the smallest (lng, lat), straight points dropped; two points
    or fewer are returned as they are."""
    if len(points) <= 2:
        return list(points)
    ordered = sorted(points)
    lower, upper = _chain(ordered, 0.0), _chain(ordered[::-1], 0.0)
    return lower[:-1] + upper[:-1]


def outer_points(xy: np.ndarray) -> np.ndarray:
    """Distinct points that may be hull vertices. Only points inside by a clear margin go, so the
    final pass decides alone about nearly straight ones."""
    xy = np.unique(xy, axis=0)
    if len(xy) <= 3:
        return xy
    span = float(np.ptp(xy, axis=0).max())
    margin = 1e-12 * max(span * span, 1e-24)
    x, y = xy[:, 0], xy[:, 1]
    # points strictly inside the polygon of eight extreme points cannot be vertices
    ring = [int(np.argmax(f)) for f in (x, x + y, y, y - x, -x, -x - y, -y, x - y)]
    inside = np.ones(len(xy), dtype=bool)
    for i, j in zip(ring, ring[1:] + ring[:1]):
        if i != j:
            inside &= (x[j] - x[i]) * (y - y[i]) - (y[j] - y[i]) * (x - x[i]) > margin
    ordered = list(map(tuple, xy[~inside].tolist()))
    kept = set(_chain(ordered, margin)) | set(_chain(ordered[::-1], margin))
    return np.array(sorted(kept))


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side partial hulls: `n` carries the number of points a batch held for a farm."""
    for batch in batches:
        batch = batch.sort_values("farm_id", kind="stable")
        ids = batch["farm_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        lengths = np.diff(np.r_[starts, len(ids)])
        large = np.repeat(lengths >= SHRINK_FROM, lengths)
        parts = [batch[~large]]
        for start, length in zip(starts[lengths >= SHRINK_FROM], lengths[lengths >= SHRINK_FROM]):
            parts.append(_outer(batch.iloc[start:start + length]))
        yield pd.concat(parts)


def _hull_of(n: int, points: list[tuple[float, float]]) -> list[dict]:
    if n > 2 and len(points) <= 2:
        points = points * 3  # repeated positions were merged; the count says there were more
    return [{"lng": x, "lat": y} for x, y in convex_hull(points)]


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hulls of farms whose rows follow each other, across batch borders. Of the farm that a batch
    ends with, only possible vertices are held once its rows have doubled."""
    held: list[pd.DataFrame] = []
    size = limit = 0
    for batch in batches:
        ids = batch["farm_id"].to_numpy()
        if held and ids[0] != held[0]["farm_id"].iloc[0]:
            yield _hulls(pd.concat(held))
            held, size = [], 0
        first = int(np.searchsorted(ids, ids[0], side="right"))
        last = int(np.searchsorted(ids, ids[-1], side="left"))
        if last:  # the batch completes the held farm, and others between
            yield _hulls(pd.concat([*held, batch.iloc[:first]]))
            if last > first:
                yield _hulls(batch.iloc[first:last])
            held, size = [], 0
        held.append(batch.iloc[last:])
        size += len(batch) - last
        if size > max(limit, HOLD):
            held = [_outer(pd.concat(held))]
            size = len(held[0])
            limit = 2 * size
    if held:
        yield _hulls(pd.concat(held))


def _outer(rows: pd.DataFrame) -> pd.DataFrame:
    """The possible vertices of one farm's rows; the first carries their number."""
    outer = outer_points(rows[["lng", "lat"]].to_numpy())
    counts = np.zeros(len(outer), dtype="int64")
    counts[0] = rows["n"].sum()
    return pd.DataFrame({"farm_id": rows["farm_id"].iloc[0], "n": counts, "seq": 1, "lng": outer[:, 0], "lat": outer[:, 1]})


def _hulls(rows: pd.DataFrame) -> pd.DataFrame:
    ids, n = rows["farm_id"].to_numpy(), rows["n"].to_numpy()
    points = list(zip(rows["lng"].tolist(), rows["lat"].tolist()))
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist()
    ends = starts[1:] + [len(ids)]
    counts = [int(n[a:b].sum()) for a, b in zip(starts, ends)]
    return pd.DataFrame({
        "farm_id": ids[starts],
        "point_count": counts,
        "boundary": [_hull_of(c, points[a:b]) for c, a, b in zip(counts, starts, ends)],
    })


def farm_hulls(farms: DataFrame, links: DataFrame, points: DataFrame, partial: bool = True) -> DataFrame:
    """Hull of each farm and its linked points: farm_id, point_count, boundary (array of struct).

    farms and points come with id, lng, lat; links are unique per farm and point.
    """
    long = lambda v: F.lit(v).cast("long")
    own = farms.select(F.col("id").alias("farm_id"), long(1).alias("n"), long(0).alias("seq"), "lng", "lat")
    where_is = points.select(F.col("id").alias("recognition_id"), "lng", "lat")
    linked = links.select("farm_id", "recognition_id").join(where_is, "recognition_id").select(
        "farm_id", long(1).alias("n"), long(1).alias("seq"), "lng", "lat"
    )
    seeds = own.unionByName(linked)
    if partial:
        seeds = seeds.mapInPandas(_combine, SCHEMA)
        # what many tasks leave of a hot farm shrinks again in a few before it meets in one
        salt = F.pmod(F.xxhash64("lng", "lat"), F.lit(SALTS))
        seeds = seeds.repartition("farm_id", salt).mapInPandas(_combine, SCHEMA)
    together = seeds.repartition("farm_id").sortWithinPartitions("farm_id", "seq")
    return together.mapInPandas(
        _finish, "farm_id long, point_count long, boundary array<struct<lng:double,lat:double>>"
    )


def hull_vertices(hulls: DataFrame) -> DataFrame:
    """One row per vertex, numbered from 0."""
    return hulls.select("farm_id", F.posexplode("boundary").alias("vertex_no", "v")).select(
        "farm_id", "vertex_no", "v.lng", "v.lat"
    )

"""Points in polygons, and polygon geometry from GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlink.functions.documents import document
from wattlink.functions.geo import crosses
from wattlink.operators.ranking import computed_once
from wattlink.session import stored

CELL_DEGREES = 0.5
LEVELS = 8  # cells of the top level are 2^8 times as wide
BROADCAST_BYTES = 64 * 1024 * 1024  # checked size of a broadcast cover


def outer_rings(geojson: DataFrame, text: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Outer rings of all Polygon and MultiPolygon features: keep…, feature_no, ring_no, ring."""
    keep = keep or []
    features = F.try_variant_get(document(F.col(text)), "$.features", "array<variant>")
    rows = geojson.select(*keep, F.posexplode(features).alias("feature_no", "f"))
    kind = F.try_variant_get("f", "$.geometry.type", "string")
    rings = "array<array<array<double>>>"
    single = F.try_variant_get("f", "$.geometry.coordinates", rings)
    multi = F.try_variant_get("f", "$.geometry.coordinates", f"array<{rings}>")
    outer = F.when(kind == "Polygon", F.array(F.get(single, F.lit(0)))).when(
        kind == "MultiPolygon", F.transform(multi, lambda p: F.get(p, F.lit(0)))
    )
    return rows.select(*keep, "feature_no", F.posexplode(outer).alias("ring_no", "r")).where(
        F.size("r") > 0
    ).select(
        *keep, "feature_no", "ring_no",
        F.transform("r", lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat"))).alias("ring"),
    )


def boundary_bounds(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Extent of all rings of a boundary together: keys, min_lng, min_lat, max_lng, max_lat."""
    each = rings.select(*keys, ring_bounds().alias("b")).select(*keys, "b.*")
    return each.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("min_lng", "min_lat")], *[F.max(c).alias(c) for c in ("max_lng", "max_lat")])


def ring_bounds(ring: str | Column = "ring") -> Column:
    """(min lng, min lat, max lng, max lat) of an array of points."""
    axis = lambda f: F.transform(ring, lambda p: p[f])
    return F.struct(
        F.array_min(axis("lng")).alias("min_lng"), F.array_min(axis("lat")).alias("min_lat"),
        F.array_max(axis("lng")).alias("max_lng"), F.array_max(axis("lat")).alias("max_lat"),
    )


def _edges(ring: str) -> Column:
    """Edge structs (xi, yi, xj, yj): each vertex with the one before it, the last closing."""
    def edge(p, i):
        before = F.element_at(F.col(ring), F.when(i == 0, F.size(ring)).otherwise(i))
        return F.struct(p["lng"].alias("xi"), p["lat"].alias("yi"), before["lng"].alias("xj"),
                        before["lat"].alias("yj"))

    return F.transform(ring, edge)


def cover(polygons: DataFrame, cell: float = CELL_DEGREES) -> DataFrame:
    """Quadtree cells that hold a part of each polygon: polygon_id, level, cx, cy, edges, inner.

    Cells of level k are `cell` * 2^k degrees wide. A polygon starts at the level of its own extent, `LEVELS` at most. A
    cell that no edge touches lies inside or outside as a whole: inside it is kept as it is, `inner` and
    without edges, outside it is dropped. Others are split down to level 0, where they keep the edges that a ray to the right can
    cross. Cells so grow with the outline of a polygon, not with its area.
    """
    cells = polygons.where(F.size("ring") >= 3).select("polygon_id", _edges("ring").alias("edges"), ring_bounds().alias("b"))
    extent = F.greatest(F.col("b.max_lng") - F.col("b.min_lng"), F.col("b.max_lat") - F.col("b.min_lat"))
    start = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(extent / cell)).cast("int"), F.lit(0))))
    cells = computed_once(cells, level=start)
    highest = cells.agg(F.max("level")).first()[0] or 0
    index = lambda c: f"shiftright(CAST(floor({c} / {cell}D) AS INT), level)"
    span = lambda lo, hi: F.explode(F.expr(f"sequence({index(lo)}, {index(hi)})"))
    cells = cells.withColumn("cy", span("b.min_lat", "b.max_lat")).withColumn("cx", span("b.min_lng", "b.max_lng"))
    cells = cells.select("polygon_id", "level", "cx", "cy", "edges", F.lit(False).alias("inner"))
    slack = 1e-9
    for level in range(highest, -1, -1):
        size = cell * 2 ** level
        left, low = F.col("cx") * F.lit(size), F.col("cy") * F.lit(size)
        # rays run to the right: only the row of the cell and what does not lie left of it matter
        met = F.filter("edges", lambda e: (F.greatest(e["yi"], e["yj"]) >= low - slack) & (F.least(e["yi"], e["yj"]) <= low + size + slack)
                       & (F.greatest(e["xi"], e["xj"]) >= left - slack))
        open_ = (F.col("level") == level) & ~F.col("inner")
        cells = computed_once(cells, edges=F.when(open_, met).otherwise(F.col("edges")))
        touched = F.exists("edges", lambda e: F.least(e["xi"], e["xj"]) <= left + size + slack)
        inside = F.size(F.filter("edges", lambda e: crosses(left + size / 2, low + size / 2, e))) % 2 == 1

        def row(level, cx, cy, edges, inner):
            return F.struct(F.lit(level).alias("level") if isinstance(level, int) else level.alias("level"), cx.alias("cx"),
                            cy.alias("cy"), edges.alias("edges"), (F.lit(inner) if isinstance(inner, bool) else inner).alias("inner"))

        cx, cy, edges = F.col("cx"), F.col("cy"), F.col("edges")
        halves = [row(level - 1, cx * 2 + i, cy * 2 + j, edges, False) for i in (0, 1) for j in (0, 1)] if level else [
            row(0, cx, cy, edges, False)]
        same = row(F.col("level"), cx, cy, edges, F.col("inner"))
        whole = row(level, cx, cy, F.slice("edges", 1, 0), True)
        cells = cells.select("polygon_id", F.inline(
            F.when(~open_, F.array(same)).when(touched, F.array(*halves)).when(inside, F.array(whole))))
    return cells


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = CELL_DEGREES) -> DataFrame:
    """All (point id, polygon_id) with the point inside, by the even-odd rule.

    points: id, lng, lat.  polygons: polygon_id, ring (array of lng/lat); fewer than three
    vertices hold nothing. A point looks at its own cell of every level that the cover of the polygons
    has; an inner cell answers without edges.
    """
    cells = stored(cover(polygons, cell), "cover")
    # at most one row per level
    seen = cells.groupBy("level").agg(F.sum(F.size("edges") * 40 + 64).alias("bytes")).collect()
    if sum(r["bytes"] for r in seen) <= BROADCAST_BYTES:
        cells = F.broadcast(cells)
    index = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("int")
    levels = F.array(*[F.lit(r["level"]) for r in seen]).cast("array<int>")
    placed = points.select("id", "lng", "lat", index("lng").alias("cx"), index("lat").alias("cy"), F.explode(levels).alias("level"))
    placed = placed.withColumns({c: F.expr(f"shiftright({c}, level)") for c in ("cx", "cy")})
    hits = F.size(F.filter("edges", lambda e: crosses(F.col("lng"), F.col("lat"), e)))
    return placed.join(cells, ["level", "cx", "cy"]).where(F.col("inner") | (hits % 2 == 1)).select("id", "polygon_id")

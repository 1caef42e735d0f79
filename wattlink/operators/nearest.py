"""Exact nearest neighbour within groups, by a grid on the unit sphere.

A probe looks for the nearest site of its group. Groups with few sites are joined directly. In
larger groups the cells of a grid are halved until few sites matter to a cell: a cell that holds a
site answers all its probes from the sites within its diagonal. Probes and the sites listed for their
finest such cell are dealt by the cell and compared there by their unit vectors, so that what is
shuffled is a row per probe, not its candidates, and a site once for each cell that lists it. A cell lists the
sites that may be nearest to one of its probes, by the box around these and the sites it holds. Where no cell on a probe's way has a short list (next to a tight cluster), the probe
descends a grid whose cells shrink by four per level: cells that cannot hold a site closer than one
already guaranteed are dropped, so the number of candidates a probe carries does not grow with the
size of its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from wattlink import constants as K
from wattlink.functions.geo import chord_of_km, haversine_km, unit_vector
from wattlink.functions.text import let
from wattlink.operators.ranking import computed_once, first_per_key
from wattlink.session import durable, spread, stored

BROADCAST_BYTES = 16 * 1024 * 1024  # checked size of a broadcast table; the driver holds several, each a few times over
DIRECT_SITES = 256  # largest group joined without descending
CELL_SITES = 256  # a cell whose list has no more sites is not halved
LONGEST_LIST = 4096  # sites of a cell's list for the probes that no finer cell answers
LISTED = 32  # sites in one row of a list
DEALT = 50_000  # probes of a cell in one part; more are dealt over several
MET = 1 << 20  # products of unit vectors held at once
HALVINGS = 14  # levels of cells with lists
PAD = 3  # cells beside the sphere, so that numbers of neighbours stay apart
LEAF_SITES = 32  # a cell with no more sites is not divided further
MAX_LEVELS = 17  # the last level's cells are a few millimetres wide
SALTS = 8  # spread of probes that share a cell
SLACK = 1e-9  # chord; covers rounding of the unit vectors (about 6 mm on the ground)


def with_vector(df: DataFrame) -> DataFrame:
    x, y, z = unit_vector(F.col("lat"), F.col("lng"))
    return computed_once(df, x=x, y=y, z=z)


def distinct_positions(sites: DataFrame, keys: list[str]) -> DataFrame:
    """One site per position and group: of several, the first by (name, id) wins every time."""
    return sites.groupBy(*keys, "lng", "lat").agg(F.min(F.struct("name", "id")).alias("_s")).select(
        *keys, "lng", "lat", F.col("_s.name").alias("name"), F.col("_s.id").alias("id")
    )


def _axis(c: Column, side: float | Column) -> Column:
    return F.floor((c + 1.0 + 4 * SLACK) / F.lit(side)).cast("long")


class Grid:
    """Cells of a fixed side on the unit sphere, numbered by one long."""

    def __init__(self, radius_km: float):
        self.reach = chord_of_km(radius_km) + SLACK
        self.side = max(2 * self.reach, 1.2e-6)
        self.row = int(2.0 / self.side) + 4

    def _key(self, ix: Column, iy: Column, iz: Column) -> Column:
        return ((ix + 1) * self.row + (iy + 1)) * self.row + (iz + 1)

    def cell(self) -> Column:
        return self._key(*[_axis(F.col(a), self.side) for a in "xyz"])

    def reachable_cells(self) -> Column:
        """Cells touched by the box of half-width `reach` around a position: eight at most."""
        spans = [
            F.sequence(_axis(F.col(a) - self.reach, self.side), _axis(F.col(a) + self.reach, self.side)) for a in "xyz"
        ]
        return F.flatten(F.transform(spans[0], lambda ix: F.flatten(F.transform(spans[1], lambda iy: F.transform(
            spans[2], lambda iz: self._key(ix, iy, iz))))))


def _closest(pairs: DataFrame, probe: list[str], max_km: float | None) -> DataFrame:
    """Pairs with coordinates of both sides to the nearest site per probe."""
    return _first_of(_measured(pairs, probe, max_km), probe)


def _measured(pairs: DataFrame, probe: list[str], max_km: float | None) -> DataFrame:
    """Pairs with coordinates of both sides by their distance, those in range."""
    if max_km is not None:
        # a cheap first test, true only of latitudes that exist
        band = math.degrees(max_km / K.EARTH_RADIUS_KM) + 1e-9
        pairs = pairs.where((F.abs(F.col("s_lat") - F.col("lat")) <= band)
                            | (F.greatest(F.abs("s_lat"), F.abs("lat")) > 90))
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))
    near = pairs.withColumn("distance", km).where(~F.isnan("distance"))
    if max_km is not None:
        near = near.where(F.col("distance") <= max_km)
    return near.select(*probe, "s_id", "s_name", "distance")


def _first_of(found: DataFrame, probe: list[str]) -> DataFrame:
    return first_per_key(found, probe, [F.col("distance"), F.col("s_name"), F.col("s_id")])


def _site_lists(sites: DataFrame) -> DataFrame:
    """Sites of each group as one array; only for groups of a checked size."""
    fields = F.struct("x", "y", "z", "lat", "lng", "name", "id")
    return with_vector(sites).groupBy("g").agg(F.collect_list(fields).alias("sites"))


def _closest_listed(probes: DataFrame, lists: DataFrame, probe: list[str], max_km: float | None) -> DataFrame:
    """Nearest site out of each group's array. A probe meets one row per group it is in and is
    answered where it stands: candidates are never rows that must be shuffled or sorted.

    Chords are cheap to compare, by the product of the unit vectors; the exact distance is taken of
    those within rounding of the shortest chord.
    """
    def squared(s: Column) -> Column:
        return F.lit(1.0) - (s["x"] * F.col("x") + s["y"] * F.col("y") + s["z"] * F.col("z"))  # half of it

    def reach(shortest: Column) -> Column:
        return shortest + F.sqrt(F.greatest(shortest, F.lit(0.0))) * (2 * SLACK) + (SLACK**2 + 1e-14)

    def exact(s: Column) -> Column:
        km = haversine_km(F.col("lat"), F.col("lng"), s["lat"], s["lng"])
        return F.struct(km.alias("distance"), s["name"].alias("s_name"), s["id"].alias("s_id"))

    chords = F.array_min(F.transform("sites", squared))
    close = let(reach(chords), lambda limit: F.filter("sites", lambda s: squared(s) <= limit))
    met = computed_once(with_vector(probes).join(lists, "g"), close=close)
    near = computed_once(met, best=F.array_min(F.transform("close", exact))).select(*probe, "best.*")
    near = near.where(~F.isnan("distance"))
    return near if max_km is None else near.where(F.col("distance") <= max_km)


def _as_site(sites: DataFrame, *extra) -> DataFrame:
    return sites.select(*extra, F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"),
                        F.col("name").alias("s_name"), F.col("id").alias("s_id"))


def nearest_in_groups(probes: DataFrame, sites: DataFrame, probe: list[str], max_km: float | None = None,
                      start_side: float = 4.0) -> DataFrame:
    """Nearest site of the same group `g` for every probe.

    probes: the identifying columns `probe`, then g, lng, lat (a probe may be in several groups).
    sites:  g, lng, lat, name, id with distinct positions inside a group.
    Ties go to the first (name, id). Returns the probe columns, s_id, s_name, distance.
    """
    sizes = sites.groupBy("g").agg(F.count("*").alias("n"), F.sum(_site_bytes()).alias("bytes"))
    crowded = F.when(F.col("n") > DIRECT_SITES, F.octet_length(F.col("g").cast("string")) + 32)
    total = sizes.agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum(crowded).alias("large")).first()
    # broadcast lists are met where the probes are; otherwise the adaptive skew join splits the
    # probes of a hot group
    placed = F.broadcast if (total["bytes"] or 0) <= BROADCAST_BYTES else (lambda lists: lists)
    if (total["n"] or 0) <= DIRECT_SITES:
        return _first_of(_closest_listed(probes, placed(_site_lists(sites)), probe, max_km), probe)
    large = durable(sizes.where(F.col("n") > DIRECT_SITES).select("g"))
    if total["large"] <= BROADCAST_BYTES:
        large = F.broadcast(large)
    split = lambda df, how: df.join(large, "g", how)
    lists = placed(_site_lists(split(sites, "left_anti")))
    direct = _closest_listed(split(probes, "left_anti"), lists, probe, max_km)
    many = stored(split(sites, "left_semi"), "sites")
    side = _start(with_vector(many), start_side)
    assigned = _assigned(split(probes, "left_semi"), _short_cells(many, side, None), side, False)
    near = _closest_in_cells(assigned, many, side, probe, max_km, placed=False)
    found = direct.unionByName(near)
    rest = assigned.where("level IS NULL").select(*dict.fromkeys([*probe, "g", "lng", "lat"]))
    if not rest.isEmpty():
        groups = durable(rest.select("g").distinct())
        found = found.unionByName(
            _closest(_descend(rest, many.join(groups, "g", "left_semi"), probe, max_km, start_side), probe, max_km))
    return _first_of(found, probe)


def _start(sites: DataFrame, side: float) -> float:
    """Side of cells of which the widest group spans a few per axis."""
    spans = sites.groupBy("g").agg(F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("span"))
    widest = max(spans.agg(F.max("span")).first()[0] or 0.0, SLACK)
    while side > widest and side > 5e-6:
        side /= 4
    return side


def _row(side: float) -> int:
    return int(2.0 / side) + 2 * PAD + 2


def _cell_at(side: float) -> Column:
    """Number of the cell of a position x, y, z."""
    ix, iy, iz = (_axis(F.col(a), side) + PAD for a in "xyz")
    return (ix * _row(side) + iy) * _row(side) + iz


def _around(side: float, reach: float) -> Column:
    """Numbers of all cells that hold a position within `reach` of some position in `cell`."""
    k = math.ceil(reach / side)
    row, steps = _row(side), range(-k, k + 1)
    offsets = [(dx * row + dy) * row + dz for dx in steps for dy in steps for dz in steps]
    return F.transform(F.array(*[F.lit(d).cast("long") for d in offsets]), lambda d: F.col("cell") + d)


def _reach(level: int, side: float, radius: float | None) -> float:
    """How far from a cell its sites may lie: within the radius, and within the diagonal where the cell
    holds a site. Cells of level 0 are listed with the whole radius, empty ones too."""
    diagonal = math.sqrt(3.0) * side / 2**level + SLACK
    return diagonal if radius is None else radius if level == 0 else min(radius, diagonal)


def _short_cells(sites: DataFrame, side: float, radius: float | None) -> list[tuple[int, DataFrame, bool]]:
    """Of each level with any: its number, its cells (g, cell, short) and whether they fit a broadcast with those of
    the levels before. The cells of level 0 that any site reaches are all there; of the others those with a short list only."""
    sites = with_vector(sites)
    out, crowded, size, sent = [], None, math.inf, 0
    for level in range(HALVINGS):
        here = side / 2**level
        if level and here < 1.2e-6:  # cell numbers must fit
            break
        own = sites.select("g", _cell_at(here).alias("cell"), *([_cell_at(2 * here).alias("parent")] if level else []))
        own = durable(own.groupBy(*own.columns).agg(F.count("*").alias("n")))
        listed = own.select("g", "n", F.explode(_around(here, _reach(level, side, radius))).alias("cell"))
        if level or radius is None:
            held = own if crowded is None else own.join(crowded, ["g", "parent"], "left_semi")
            held = held.select("g", "cell").distinct()
            # a crowded cell holds eight cells of the next level at most
            listed = listed.join(F.broadcast(held) if 8 * size <= BROADCAST_BYTES else held, ["g", "cell"], "left_semi")
        sized = durable(listed.groupBy("g", "cell").agg(F.sum("n").alias("n")))
        kept = F.lit(level == 0 and radius is not None) | (F.col("n") <= LONGEST_LIST)
        many = F.col("n") > min(CELL_SITES, DIRECT_SITES)
        total = sized.agg(F.sum(F.when(kept, _key_bytes())), F.sum(F.when(many, _key_bytes()))).first()
        if total[0]:
            known = sized.where(kept).select("g", "cell", (F.col("n") <= LONGEST_LIST).alias("short"))
            small = sent + total[0] <= BROADCAST_BYTES  # the probes meet all of them in one job
            sent += total[0] if small else 0
            out.append((level, known, small))
        if not total[1]:
            break
        size = total[1]
        crowded = sized.where(many).select("g", F.col("cell").alias("parent"))
        if size <= BROADCAST_BYTES:
            crowded = F.broadcast(crowded)
    return out


def _key_bytes() -> Column:
    return F.octet_length(F.col("g").cast("string")) + 32


def _assigned(probes: DataFrame, cells: list[tuple[int, DataFrame, bool]], side: float, reached: bool) -> DataFrame:
    """Probes with the level and cell of their finest short list, nulls without one. With `reached`, probes
    whose cell of level 0 no site reaches go."""
    kept = probes.columns
    out = with_vector(probes).withColumns({"level": F.lit(None).cast("int"), "cell": F.lit(None).cast("long")})
    for level, known, small in cells:
        known = known.select("g", F.col("cell").alias("_at"), F.col("short").alias("_short"))
        out = out.withColumn("_at", _cell_at(side / 2**level)).join(
            F.broadcast(known) if small else known, ["g", "_at"], "inner" if reached and level == 0 else "left")
        out = out.withColumns({"level": F.when(F.col("_short"), F.lit(level)).otherwise(F.col("level")),
                               "cell": F.when(F.col("_short"), F.col("_at")).otherwise(F.col("cell"))}).drop("_at", "_short")
    if reached and not any(level == 0 for level, _, _ in cells):
        out = out.where(F.lit(False))
    return stored(out.select(*kept, "level", "cell"), "probes")


def _closest_in_cells(assigned: DataFrame, sites: DataFrame, side: float, probe: list[str], max_km: float | None,
                      placed: bool, radius: float | None = None) -> DataFrame:
    """Sites that may be nearest to probes with a cell, out of the lists of the cells that have probes. With `placed`
    the lists are broadcast, otherwise they and the probes are dealt by the cell."""
    wanted = durable(with_vector(assigned.where("level IS NOT NULL")).groupBy(*CELL).agg(F.count("*").alias("n"), *_extent()))
    levels = sorted(r[0] for r in wanted.select("level").distinct().collect())  # at most HALVINGS
    probes = assigned.where("level IS NOT NULL").select(*dict.fromkeys([*probe, "lng", "lat"]), *[c for c in CELL if c not in probe])
    if not levels:
        return probes.select(*probe, F.lit(None).cast(sites.schema["id"].dataType).alias("s_id"), F.lit(None).cast("string").alias("s_name"),
                             F.lit(None).cast("double").alias("distance")).where(F.lit(False))
    # all levels in one join: a plan with a branch for each takes the driver's memory, above all while it is adapted
    fields = F.struct("x", "y", "z", "lat", "lng", "name", "id").alias("site")
    at = [F.struct(F.lit(level).alias("level"), _cell_at(side / 2**level).alias("near")) for level in levels]
    own = with_vector(sites).select("g", fields, F.inline(F.array(*at))).groupBy("level", "g", "near").agg(
        F.collect_list("site").alias("sites"))
    here, row, reach = (F.get(F.array(*[F.lit(f(level)) for level in range(HALVINGS)]), F.col("level")) for f in (
        lambda level: side / 2**level, lambda level: _row(side / 2**level), lambda level: _reach(level, side, radius)))
    asked = _bounded_cells(wanted, own, reach).withColumns({"_side": here, "_row": row}).withColumn("near", F.explode(_touched()))
    matter = F.filter("sites", lambda s: _gap(s) <= F.col("bound"))
    lists = asked.join(own, ["level", "g", "near"]).select(*CELL, "n", matter.alias("sites")).where(F.size("sites") > 0)
    if placed:
        cell = F.struct(*CELL).alias("g")
        lists = lists.groupBy(cell).agg(F.flatten(F.collect_list("sites")).alias("sites"))
        return _closest_listed(probes.select(*dict.fromkeys([*probe, "lng", "lat"]), cell), F.broadcast(lists), probe, max_km)
    return _measured(_met(probes, lists, wanted, probe), probe, max_km)


CELL = ["level", "g", "cell"]


def _extent() -> list[Column]:
    return [f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]


def _root(*lengths: Column) -> Column:
    return F.sqrt(reduce(Column.__add__, [v * v for v in lengths]))


def _gap(s: Column) -> Column:
    """Least distance of a site from the box of the probes."""
    return _root(*[F.greatest(F.col(f"min_{a}") - s[a], F.lit(0.0), s[a] - F.col(f"max_{a}")) for a in "xyz"])


def _far(s: Column) -> Column:
    """Distance of a site from the farthest corner of the box of the probes."""
    return _root(*[F.greatest(F.abs(s[a] - F.col(f"min_{a}")), F.abs(s[a] - F.col(f"max_{a}"))) for a in "xyz"])


def _bounded_cells(wanted: DataFrame, own: DataFrame, reach: Column) -> DataFrame:
    """Cells with `bound`: how far from the box of its probes a site may be that is nearest to one of
    them. No probe is farther from a site of its cell than the farthest corner of the box is."""
    held = wanted.join(own.withColumnRenamed("near", "cell"), CELL, "left")
    shown = F.array_min(F.transform("sites", _far)) + 2 * SLACK
    return held.withColumn("bound", F.least(reach, F.coalesce(shown, reach))).drop("sites")


def _touched() -> Column:
    """Numbers of all cells of side `_side`, `_row` in a row, that hold a position within `bound` of the box of the probes."""
    side, row = F.col("_side"), F.col("_row")
    x, y, z = (F.sequence(_axis(F.col(f"min_{a}") - F.col("bound"), side) + PAD,
                          _axis(F.col(f"max_{a}") + F.col("bound"), side) + PAD) for a in "xyz")
    return F.flatten(F.transform(x, lambda i: F.flatten(F.transform(y, lambda j: F.transform(
        z, lambda k: (i * row + j) * row + k)))))


def _met(probes: DataFrame, lists: DataFrame, wanted: DataFrame, probe: list[str]) -> DataFrame:
    """Pairs of probes and sites out of their cell's list whose chord is the shortest, within rounding.

    The sites of a cell precede its probes in their partition. They are bounded, and probes stream past them, so the
    memory of a task does not depend on how many probes share a cell; those of a crowded cell are dealt over parts.
    """
    parts = F.ceil(F.col("n") / DEALT).cast("int")
    crowded = wanted.where(F.col("n") > DEALT).select(*CELL, parts.alias("_parts"))  # one row for `DEALT` probes at most
    part = F.pmod(F.xxhash64(*dict.fromkeys([*probe, "lng", "lat"])), F.coalesce("_parts", F.lit(1))).cast("int")
    left = probes.join(F.broadcast(crowded), CELL, "left").withColumn("_part", part).drop("_parts")
    some = F.transform(F.sequence(F.lit(1), F.size("sites"), F.lit(LISTED)), lambda i: F.slice("sites", i, LISTED))
    right = lists.withColumn("sites", F.explode(some)).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    key = [*CELL, "_part"]
    both = spread(left.unionByName(right, allowMissingColumns=True), *key).sortWithinPartitions(*key, F.col("sites").isNull())
    carried = list(dict.fromkeys([*probe, "lat", "lng"]))
    site = {f.name: f.dataType for f in lists.schema["sites"].dataType.elementType.fields}
    names = ["lat", "lng", "name", "id"]
    schema = StructType([StructField(c, both.schema[c].dataType) for c in carried]
                        + [StructField(f"s_{c}", site[c]) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sites, xyz, last = [], None, None, None  # of the cell at hand
        for b in batches:
            n, is_site = b.num_rows, b.column("sites").is_valid().to_numpy(zero_copy_only=False)
            new = np.zeros(n, bool)
            for k in key:
                c = b.column(k)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = tuple(b.column(k)[0].as_py() for k in key)
            new[0] = first != last
            last = tuple(b.column(k)[n - 1].as_py() for k in key)
            rad = math.pi / 180
            lat, lng = (b.column(c).to_numpy(zero_copy_only=False) * rad for c in ("lat", "lng"))
            at = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)
            cuts = np.flatnonzero(new | np.concatenate([[True], is_site[1:] != is_site[:-1]])).tolist()
            rows, near = [], []
            for begin, end in zip(cuts, cuts[1:] + [n]):
                if new[begin]:
                    pieces, sites = [], None
                if is_site[begin]:
                    pieces.append(b.column("sites").slice(begin, end - begin).flatten())
                    continue
                if sites is None:
                    sites = pa.concat_arrays(pieces) if pieces else pa.array([], b.column("sites").type.value_type)
                    by_name = dict(zip(site, sites.flatten()))
                    xyz = np.stack([by_name[c].to_numpy(zero_copy_only=False) for c in "xyz"])
                if not len(sites):
                    continue
                step = max(1, MET // len(sites))
                for a in range(begin, end, step):
                    half = 1.0 - at[a:min(a + step, end)] @ xyz  # half the squared chord
                    shortest = np.fmin.reduce(half, axis=1)
                    limit = shortest + np.sqrt(np.maximum(shortest, 0.0)) * (2 * SLACK) + (SLACK**2 + 1e-14)
                    probe_at, site_at = np.nonzero(half <= limit[:, None])
                    rows.append(probe_at + a)
                    near.append(sites.take(pa.array(site_at)))
            if rows:
                found = dict(zip(site, pa.concat_arrays(near).flatten()))
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(c).take(rows) for c in carried] + [found[c] for c in names],
                                                 [*carried, *[f"s_{c}" for c in names]])

    return both.select(*carried, *[k for k in key if k not in carried], "sites").mapInArrow(run, schema)


def _site_bytes() -> Column:
    """Upper estimate of what a site takes in a list."""
    return F.lit(120) + F.octet_length("name")


def _descend(probes: DataFrame, sites: DataFrame, probe: list[str], max_km: float | None, side: float) -> DataFrame:
    """Candidate pairs for probes whose group has many sites."""
    limit = 4.0 if max_km is None else (chord_of_km(max_km) + SLACK) ** 2
    sites = durable(with_vector(sites))
    probes = durable(with_vector(probes))
    side = _start(sites, side)
    carried = [*dict.fromkeys([*probe, "lng", "lat"]), "x", "y", "z"]

    def cells(level: int) -> dict[str, Column]:
        return {f"c{a}": _axis(F.col(a), side / 4**level) for a in "xyz"}

    def nodes(level: int) -> DataFrame:
        return sites.withColumns(cells(level)).groupBy("g", "cx", "cy", "cz").agg(F.count("*").alias("n"), *_extent())

    def bounded(frontier: DataFrame) -> DataFrame:
        """Squared chord bounds between probe and cell content; drop what cannot win."""
        low = high = F.lit(0.0)
        for a in "xyz":
            p, lo, hi = F.col(a), F.col(f"min_{a}"), F.col(f"max_{a}")
            gap = F.greatest(lo - p, F.lit(0.0), p - hi)
            far = F.greatest(F.abs(p - lo), F.abs(p - hi))
            low, high = low + gap * gap, high + far * far
        seen = frontier.withColumns({"low": low, "high": high}).where(F.col("low") <= limit)
        best = F.min("high").over(Window.partitionBy(*probe))
        seen = seen.withColumn("best", F.least(best, "best") if "best" in frontier.columns else best)
        return seen.where(F.sqrt("low") <= F.sqrt("best") + SLACK)

    frontier, leaves = probes.join(nodes(0), "g"), []
    for level in range(MAX_LEVELS):
        frontier = durable(bounded(frontier).select(*carried, "g", "cx", "cy", "cz", "n", "best"))
        last = level == MAX_LEVELS - 1
        leaf = frontier if last else frontier.where(F.col("n") <= LEAF_SITES)
        leaves.append(leaf.select(F.lit(level).alias("level"), *carried, "g", "cx", "cy", "cz"))
        rest = frontier.where(F.col("n") > LEAF_SITES)
        if last or rest.isEmpty():
            break
        parents = rest.select("g", "cx", "cy", "cz").distinct()
        child = nodes(level + 1).withColumnsRenamed({"cx": "kx", "cy": "ky", "cz": "kz"}).withColumns(
            {f"c{a}": F.floor(F.col(f"k{a}") / 4).cast("long") for a in "xyz"}
        )
        child = child.join(parents, ["g", "cx", "cy", "cz"], "left_semi")
        frontier = (
            _salted(rest.drop("n"), child, ["g", "cx", "cy", "cz"], probe)
            .drop("cx", "cy", "cz").withColumnsRenamed({"kx": "cx", "ky": "cy", "kz": "cz"})
        )
    # the leaves of all levels in one join, as the lists above
    at = [F.struct(F.lit(level).alias("level"), *[c.alias(n) for n, c in cells(level).items()]) for level in range(len(leaves))]
    key = ["level", "g", "cx", "cy", "cz"]
    content = _as_site(sites.select("*", F.inline(F.array(*at))), *key)
    return _salted(reduce(DataFrame.unionByName, leaves), content, key, probe).select(*carried, "s_lat", "s_lng", "s_name", "s_id")


def _salted(many: DataFrame, few: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Inner join where any number of `many` rows may share a key that has few rows in `few`."""
    salt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return many.withColumn("_salt", salt).join(few.withColumn("_salt", spread), [*keys, "_salt"]).drop("_salt")


def nearest_within(points: DataFrame, sites: DataFrame, radius_km: float, strategy: str = "auto") -> DataFrame:
    """Nearest site within `radius_km` (inclusive) of each point: id, s_id, s_name, distance.

    points: id, lng, lat.  sites: id, name, lng, lat. Every point falls in exactly one grid cell,
    whose list holds the sites of the cells its radius can touch. `strategy` is 'auto', 'broadcast'
    or 'shuffle'; 'broadcast' sends the lists to the points, the others deal both by the cell.
    """
    if radius_km is None or not radius_km >= 0:  # a radius that is no number matches nothing
        return points.select("id", F.lit(None).cast("long").alias("s_id"), F.lit(None).cast("string").alias("s_name"),
                             F.lit(None).cast("double").alias("distance")).where(F.lit(False))
    grid = Grid(radius_km)
    alone = stored(distinct_positions(sites, []).withColumn("g", F.lit(0)), "sites")
    probes = points.select("id", F.lit(0).alias("g"), "lng", "lat")
    assigned = _assigned(probes, _short_cells(alone, grid.side, grid.reach), grid.side, True)
    found = _closest_in_cells(assigned, alone, grid.side, ["id"], radius_km, strategy == "broadcast", grid.reach)
    rest = assigned.where("level IS NULL").select("id", "lng", "lat")
    if not rest.isEmpty():
        # points on the same position share the search
        spots = spread(with_vector(rest.select("lng", "lat").distinct()).select(grid.cell().alias("g"), "lng", "lat"), "lng", "lat")
        cells = durable(spots.select("g").distinct())
        listed = with_vector(alone).select("lng", "lat", "name", "id", F.explode(grid.reachable_cells()).alias("g"))
        pairs = _descend(spots, listed.join(cells, "g", "left_semi"), ["lng", "lat"], radius_km, grid.side)
        best = _closest(pairs, ["lng", "lat"], radius_km)
        found = found.unionByName(rest.join(best, ["lng", "lat"]).select("id", "s_id", "s_name", "distance"))
    return _first_of(found, ["id"])

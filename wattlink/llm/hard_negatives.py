"""Hard negatives of anchors, by slot-decomposed selection.

An anchor has several positives, the rows of its label that score highest. Every positive asks for the
negatives (rows of other labels) that score highest within a window whose limits are shares of its own score.
Windows of one anchor overlap. Their upper limits cut the scores into disjoint slots: slot j holds scores
from above the next lower limit up to limit j. Each task keeps the top k rows of a slot for every anchor,
which merge into the top k over all tasks, and a window's answer is read off its own slot followed by
the lower ones, in falling order, up to its lower limit.

All rows are dealt over groups; every anchor goes to each group, and one task multiplies a group by its
anchors in blocks. There are as many groups as shuffle partitions, more where a group would
exceed `GROUP_BYTES`, so a task holds one group of bounded size. Nothing is broadcast or collected.

Scores are exact integers, as long as they are below 2^63. Ties go to the smaller id.

Cases: rows without an id, a label or a vector take no part, nor do vectors with a null; a shorter vector
counts as ending in zeros, so an empty vector scores 0 with all; rows of one id count as rows each, and of repeated
anchors each has its own result; a positive whose window is empty has no rows; columns other than id,
label and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from wattlink.llm.common import written
from wattlink.operators.ranking import top_per_key

GROUP_BYTES = 64 << 20  # of vectors held by a task
PAIRS = 1 << 20         # scores computed at a time


@dataclass(frozen=True)
class Limits:
    """A negative of score s fits a positive of score p if low * p <= per * s <= high * p."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    per: int = 100


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact as long as no sum can leave 2^53."""
    most = lambda x: int(max(x.max(initial=0), -int(x.min(initial=0))))
    if most(queries) * most(rows) * max(rows.shape[1], 1) < 1 << 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _top(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the k highest fitting scores of every query; rows are in the order of ties."""
    lowest = np.iinfo(np.int64).min
    if scores.shape[1] > k:
        cut = np.partition(np.where(fits, scores, lowest), -k, axis=1)[:, -k]
        fits = fits & (scores >= cut[:, None])
    query, row = np.nonzero(fits)
    order = np.lexsort((row, -scores[query, row], query))
    query, row = query[order], row[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], row[place < k]


def _dealt(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Rows of every group, then all anchors, in one partition per group."""
    far = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in ("uppers", "least")]
    members = rows.select(F.pmod("rid", F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("asks"), "rid", "id", "label", "v", *far)
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    asking = anchors.select(each, F.lit(1).alias("asks"), "rid", "id", "label", "v", "uppers", "least")
    return members.unionByName(asking).repartitionById(groups, "g").sortWithinPartitions("g", "asks", "id", "rid")


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, width: int, k: int, same: bool) -> DataFrame:
    """anchor (rid), slot, id, score: the k best of each slot within each group. With `same`, rows of the
    anchor's label but itself, in one slot; else rows of other labels."""
    def answers(m: dict, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rid, label, query = b["rid"].to_numpy(), b["label"].to_numpy(), _vectors(b["v"], width)
        scores = _scores(query, m["v"])
        if same:
            slots = [(label[:, None] == m["label"]) & (rid[:, None] != m["rid"])]
        else:
            other = (label[:, None] != m["label"]) & (scores >= b["least"].to_numpy()[:, None])
            uppers = b["uppers"].to_pylist()
            slots = []
            for j in range(max(map(len, uppers), default=0)):
                of = lambda j, none: np.array([u[j] if j < len(u) else none for u in uppers], np.int64)[:, None]
                below = np.iinfo(np.int64).min
                has = np.array([j < len(u) for u in uppers])[:, None]
                lower = np.array([u[j + 1] if j + 1 < len(u) else below for u in uppers], np.int64)[:, None]
                slots.append(other & has & (scores <= of(j, below)) & ((scores > lower) | (lower == below)))
        for slot, fits in enumerate(slots):
            at, row = _top(scores, fits, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[at]), pa.array(np.full(len(at), slot, np.int32)), pa.array(m["id"][row]), pa.array(scores[at, row])],
                ["anchor", "slot", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, members = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b["g"].to_numpy().astype(np.int64) * 2 + b["asks"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                part, asks = b.slice(x, y - x), bool(key[x] % 2)
                if key[x] // 2 != group:
                    group, parts, members = key[x] // 2, [], None
                if not asks:
                    parts.append({"rid": part["rid"].to_numpy(), "id": part["id"].to_numpy(), "label": part["label"].to_numpy(),
                                  "v": _vectors(part["v"], width)})
                    continue
                if not parts:
                    continue
                if members is None:
                    members = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
                    parts = parts[:1]
                step = max(1, PAIRS // len(members["id"]))
                for a in range(0, part.num_rows, step):
                    yield from answers(members, part.slice(a, step))

    return _dealt(rows, anchors, groups).mapInArrow(run, "anchor long, slot int, id long, score long")


def mined(rows: DataFrame, is_anchor: Column, limits: Limits = Limits()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows of id (long),
    label (long) and v (array of long); `is_anchor` is a condition on id."""
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    rows = rows.where(usable).select("id", "label", "v", F.monotonically_increasing_id().alias("rid"))
    rows = written(rows, "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-n * max(width, 1) * 8 // GROUP_BYTES))
    anchors = rows.where(is_anchor)
    order = [F.desc("score"), F.asc("id")]

    plain = anchors.withColumn("uppers", F.lit(None).cast("array<long>")).withColumn("least", F.lit(None).cast("long"))
    near = _searched(rows, plain, groups, width, limits.positives, same=True)
    positives = top_per_key(near, ["anchor"], order, limits.positives, "place")
    floor = lambda share: F.expr(f"({share} * score - pmod({share} * score, {limits.per})) div {limits.per}")
    positives = written(positives.select(
        "anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        floor(limits.high).alias("upper"), (-floor(-limits.low)).alias("lower")).where("lower <= upper"), "positives")

    windows = positives.groupBy("anchor").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("least"))  # at most one per positive
    asking = anchors.join(windows.withColumnRenamed("anchor", "rid"), "rid")
    kept = top_per_key(_searched(rows, asking, groups, width, limits.negatives, same=False), ["anchor", "slot"], order,
                       limits.negatives, "place")
    # slots in falling order, each in falling order: at most `negatives` entries of as many slots as positives
    falling = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        "slot", "place", "score", F.col("id").alias("negative_id")))).alias("falling"))
    inside = lambda x: (x["score"] <= F.col("upper")) & (x["score"] >= F.col("lower"))
    chosen = positives.join(falling, "anchor").join(anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return chosen.select(
        "anchor_id", "positive_id", "positive_score",
        F.posexplode(F.slice(F.filter("falling", inside), 1, limits.negatives)).alias("pos", "one")).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("one.negative_id").alias("negative_id"),
        "positive_score", F.col("one.score").alias("negative_score"))

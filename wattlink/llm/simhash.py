"""Near-duplicate groups by SimHash with multi-index hashing.

A fingerprint is 64 bits over the 3-word shingles of a text. Two fingerprints link at two or fewer
differing bits; a group is a connected component of links. With two 32-bit segments, a linked pair
agrees in one segment up to one bit (pigeonhole), so each fingerprint is listed under both segments
and looks up the ball of radius one around each. Where one segment value lists more fingerprints
than a ball of the other segment has members, pairs within that list are not made: each of its
fingerprints looks up the ball of the remaining segment instead, so the work per fingerprint is
bounded by the ball, not by the group. Every distance is verified.

Copies share one fingerprint and count once. Components grow by hooking every node to its smallest
neighbour and shortening paths, on edges that contract each round.

Cases: null and empty texts have fingerprint zero and link like any other; a text of fewer than three
words has one shingle; a group is named after its smallest id that is not null; doc_id identifies a document;
repeated rows stay as they are. Extra columns pass through `keep_first` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wattlink.llm.common import Words, text_blocks, written
from wattlink.operators.ranking import first_per_key

SHINGLE, RADIUS, HALF = 3, 2, 32
# fingerprints of one segment value from which the remaining segment's ball is looked up instead:
# a ball of radius two in 32 bits has 1 + 32 + 496 members
BALL_FROM = 529
BLOCK_BYTES = 2_000_000
BLOCK_SHINGLES = 1 << 18


def _fingerprints_of(texts: list) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for begin, end in text_blocks(texts, BLOCK_BYTES):
        w = Words(texts[begin:end])
        n = np.diff(w.first)
        # words joined by one blank each: a shingle is one span of that buffer
        size = w.end - w.begin
        start = np.concatenate([[0], np.cumsum(size + 1)])
        inside = np.zeros(len(w.data) + 1, np.int8)
        inside[w.begin], inside[w.end] = 1, -1
        kept = np.cumsum(inside[:-1], dtype=np.int8) > 0
        # every word ends before a separator, so the byte behind it is free for the one blank
        kept[w.end] = True
        joined = w.data.copy()
        joined[w.end] = 32
        joined = joined[kept].tobytes()
        shingles = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
        doc = np.repeat(np.arange(end - begin), shingles)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        lead = w.first[doc] + place
        tail = np.minimum(lead + SHINGLE, w.first[doc + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(start[lead].tolist(), (start[tail] - 1).tolist())), np.uint64, len(doc)
        )
        votes = np.zeros((end - begin, 64), np.int64)
        for a in range(0, len(doc), BLOCK_SHINGLES):
            part = doc[a:a + BLOCK_SHINGLES]
            runs = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            bits = np.unpackbits(hashes[a:a + BLOCK_SHINGLES].astype(">u8").view(np.uint8)).reshape(-1, 64)
            votes[part[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int32)
        majority = (2 * votes > shingles[:, None]).astype(np.uint8)
        out[begin:end] = np.packbits(majority, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _fingerprints_of(b.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, k: int) -> Column:
    return fp.bitwiseAND(F.lit((1 << HALF) - 1)) if k == 0 else F.shiftrightunsigned(fp, HALF)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints, a < b, at distance two or less, from distinct `fp`.

    A pair whose segment k differs in at most one bit is met under that segment: by the fingerprint
    whose bit is 0 looking up the value with the bit set, or under the same value.
    """
    fp = F.col("fp")
    pieces = [F.struct(_segment(fp, k).alias("key"), F.lit(k).alias("seg")) for k in (0, 1)]
    listed = prints.select("fp", F.inline(F.array(*pieces)))
    crowded = written(listed.groupBy("seg", "key").count().where(F.col("count") > BALL_FROM).select("seg", "key"), "crowded")
    calm = listed.join(crowded, ["seg", "key"], "left_anti")
    probe_keys = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda i: F.call_function("getbit", F.col("key"), i) == 0),
        lambda i: F.col("key") + F.call_function("shiftleft", F.lit(1).cast("long"), i),
    )
    around = listed.select("seg", F.col("fp").alias("other"), F.explode(probe_keys).alias("key"))
    same = listed.select("seg", "key", F.col("fp").alias("other"))
    a, b = F.least("fp", "other"), F.greatest("fp", "other")
    pairs = calm.join(around.unionByName(same), ["seg", "key"]).where(
        (F.col("fp") != F.col("other")) & (_distance(F.col("fp"), F.col("other")) <= RADIUS)
    ).select(a.alias("a"), b.alias("b"))
    # crowded lists: look up whole fingerprints, within the value and in the values one bit away
    hot = listed.join(crowded, ["seg", "key"], "left_semi")
    hot_near = around.join(crowded, ["seg", "key"], "left_semi")

    def flips(radius: int) -> Column:
        bits = F.sequence(F.lit(0), F.lit(HALF - 1))
        one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        single = F.transform(bits, one)
        if radius == 1:
            return F.concat(F.array(F.lit(0).cast("long")), single)
        double = F.flatten(F.transform(bits, lambda i: F.transform(
            F.filter(bits, lambda j: j > i), lambda j: one(i).bitwiseOR(one(j)))))
        return F.concat(single, double)

    def at_other(flip: Column) -> Column:
        """Place flips of the other segment into the whole fingerprint."""
        return F.when(F.col("seg") == 0, F.call_function("shiftleft", flip, F.lit(HALF))).otherwise(flip)

    within = hot.select("seg", "fp", F.explode(flips(2)).alias("flip")).select(
        F.col("fp").alias("from"), F.col("fp").bitwiseXOR(at_other(F.col("flip"))).alias("fp"))
    moved = F.when(F.col("seg") == 0, F.col("other").bitwiseAND(F.lit(-(1 << HALF))).bitwiseOR(F.col("key"))).otherwise(
        F.col("other").bitwiseAND(F.lit((1 << HALF) - 1)).bitwiseOR(F.call_function("shiftleft", F.col("key"), F.lit(HALF))))
    beside = hot_near.select("seg", "other", moved.alias("moved"), F.explode(flips(1)).alias("flip")).select(
        F.col("other").alias("from"), F.col("moved").bitwiseXOR(at_other(F.col("flip"))).alias("fp"))
    exact = within.unionByName(beside).join(prints.select("fp"), "fp").where(
        _distance(F.col("fp"), F.col("from")) <= RADIUS
    ).select(F.least("fp", "from").alias("a"), F.greatest("fp", "from").alias("b"))
    return pairs.unionByName(exact).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component with an edge, from pairs (a, b)."""
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            e.select(F.col("b").alias("node"), F.col("a").alias("near")))

    edges = written(edges.select("a", "b"), "edges")
    roots: list[DataFrame] = []
    while not edges.isEmpty():
        # every node hooks to its smallest neighbour if that is smaller: a forest
        parents = written(both(edges).groupBy("node").agg(F.min("near").alias("near")).select(
            "node", F.least("node", "near").alias("root")), "parents")
        while True:  # shorten until every node points at a root
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(parents.join(up, "root", "left").select(
                "node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jumped")
            parents = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        roots.append(parents)
        of = lambda name: parents.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        edges = written(edges.join(of("a"), "a").join(of("b"), "b").select(
            F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")
        ).where("a < b").distinct(), "edges")
    if not roots:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def through(low: DataFrame, high: DataFrame) -> DataFrame:
        # every node of a later round is a node of the round before
        top = high.select(F.col("node").alias("root"), F.col("root").alias("top"))
        return low.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    return reduce(lambda high, low: through(low, high), reversed(roots[:-1]), roots[-1])


def groups(prints: DataFrame) -> DataFrame:
    """Per row of doc_id, fp: component_id, the smallest doc_id reachable over links."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    member = components(links(distinct.select("fp")))
    named = distinct.join(member.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named, "members")
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(names, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row of `docs`."""
    found = groups(written(fingerprints(docs), "prints"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group stays: that with the smallest doc_id, one row if that id is repeated.
    A row without a doc_id cannot be named as the first of a group and stays."""
    first = groups(written(fingerprints(docs), "prints")).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))  # whatever its columns are called
    stay = rows.join(first, "doc_id", "left_semi")
    order = [F.xxhash64("row.text").asc(), F.col("row.text").asc()]
    return first_per_key(stay, ["doc_id"], order).unionByName(rows.where("doc_id IS NULL")).select("row.*")

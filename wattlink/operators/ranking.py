"""Positions in an order, and one row per key, without gathering a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattlink.session import durable

# A window row_number() == 1 is planned with a partial group limit ahead of the shuffle: every
# task sends at most one row per key, however many rows a key holds.


def first_per_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order. Nulls in keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list, order: list[Column], n: int, position: str = "position") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= n)


def numbered(
    df: DataFrame, order: list[Column], groups: list[str] | None = None, name: str = "row_no", start: int = 1
) -> DataFrame:
    """Consecutive numbers in the given (total) order, per group if groups are named.

    A range sort cuts the order into partitions, also inside one large group. Rows are numbered
    within their partition and shifted by the row counts of the partitions before it.
    """
    groups = groups or []
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(parts), *[F.col(g) for g in groups], *order)
    ranged = durable(ranged.sortWithinPartitions(*[F.col(g) for g in groups], *order))
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    return _shifted(placed, groups, name, start)


def in_read_order(df: DataFrame, name: str = "row_no", start: int = 1) -> DataFrame:
    """Consecutive numbers in the order in which the partitions of `df` deliver rows."""
    placed = (
        durable(df).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    )
    return _shifted(placed, [], name, start)


def _shifted(placed: DataFrame, groups: list[str], name: str, start: int) -> DataFrame:
    # one row per partition and group in it: as many rows as groups plus partitions
    pieces = placed.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    if not groups:
        # at most one row per partition
        rows, before, offsets = pieces.orderBy("_part").collect(), 0, []
        for row in rows:
            offsets.append((row["_part"], row["_first"], before))
            before += row["_n"]
        spark = placed.sparkSession
        table = spark.createDataFrame(offsets, "_part int, _first long, _before long")
        out = placed.join(F.broadcast(table), "_part")
    else:
        earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        table = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
        out = placed.join(table, [*groups, "_part"])
    number = F.col("_seq") - F.col("_first") + F.col("_before") + F.lit(start)
    return out.withColumn(name, number).drop("_part", "_seq", "_first", "_before")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator; without columns, all of `df` goes through it.

    The optimizer copies an expression into every filter and join key derived from it, and again
    for every stage below, but it does not move anything across a generator.
    """
    if not columns:
        return df.select(F.inline(F.array(F.struct(*df.columns))))
    added = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], added)

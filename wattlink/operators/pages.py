"""Deep pages of an ordered table: rows are stored by key range, and a page reads the ranges that hold it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wattlink.session import scratch_path


@dataclass(frozen=True)
class OrderedPages:
    path: str
    order: tuple[str, ...]   # falling; equal rows of all of these share a range
    schema: StructType
    rows_before: list[int]   # of each range and, at last, of the end: one number per range

    @property
    def total(self) -> int:
        return self.rows_before[-1]

    def page(self, spark: SparkSession, page_no: int = 1, size: int = 10) -> DataFrame:
        """One page in falling order; beyond the last row it is empty."""
        begin = (max(page_no, 1) - 1) * size
        holding = [k for k, (a, b) in enumerate(zip(self.rows_before, self.rows_before[1:])) if a < begin + size and b > begin]
        rows = _read(spark, self.path, self.schema)
        if not holding:
            return rows.where(F.lit(False)).drop("_range")
        chosen = rows.where(F.col("_range").between(holding[0], holding[-1])).drop("_range")
        return chosen.orderBy(*map(F.desc, self.order)).offset(begin - self.rows_before[holding[0]]).limit(size)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("_range", IntegerType())])).parquet(path)


def ordered_pages(df: DataFrame, order: tuple[str, ...] = ("id",), ranges: int | None = None, path: str | None = None) -> OrderedPages:
    """Store `df` by ranges of falling `order`, one sort for all pages to come. Nulls come last."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch_path(spark, "pages")
    falling = [F.desc(c) for c in order]
    dealt = df.repartitionByRange(ranges, *falling).withColumn("_range", F.spark_partition_id())
    dealt.sortWithinPartitions("_range", *falling).write.partitionBy("_range").parquet(path)
    # one row per range
    counts = {r["_range"]: r["count"] for r in _read(spark, path, df.schema).groupBy("_range").count().collect()}
    return OrderedPages(path, tuple(order), df.schema, list(accumulate((counts.get(k, 0) for k in range(ranges)), initial=0)))

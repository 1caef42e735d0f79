"""Keyword search over postings of folded trigrams, with verification.

The rows are stored in blocks by ranges of their ids. A posting says that a row of a block holds a trigram in one
of the searched columns. A term is looked up by the rarest of its trigrams, what several terms name is intersected,
only blocks with a candidate are read, and the search condition itself decides. Wildcards cut a term into parts; a
term without a part of three characters, or whose rarest trigram more than a `COMMON` share of all rows holds,
narrows nothing: if no term does, all blocks are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wattlink.functions.text import fold_case, fold_term
from wattlink.operators import views
from wattlink.operators.containment import GRAM, _grams
from wattlink.session import scratch_path

BUCKETS = 64      # folders of postings by trigram
COMMON = 0.25
POSTING = "gram long, _id long, _block int, bucket int"
HELD = "gram long, held long, bucket int"


@dataclass(frozen=True)
class SearchIndex:
    path: str
    schema: StructType
    id_column: str
    total: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField("_block", IntegerType())])).parquet(f"{self.path}/rows")

    def rarest(self, spark: SparkSession, term: str) -> tuple[int, int] | None:
        """(trigram, rows that hold it) of the rarest trigram of a term; none without one. A trigram that no row
        holds counts 0."""
        parts = [p for p in re.split("[%_]", fold_term(term)) if len(p) >= GRAM]
        if not parts:
            return None
        grams = [g for (found,) in spark.createDataFrame([(p,) for p in parts], "part string").select(
            _grams(F.col("part"), F.lit(GRAM))).collect() for g in found]
        held = spark.read.schema(HELD).parquet(f"{self.path}/held").where(_in_buckets(grams))
        counts = {r["gram"]: r["held"] for r in held.collect()}  # at most one row per trigram of the term
        return min(((g, counts.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))

    def candidates(self, spark: SparkSession, terms: list[str]) -> DataFrame | None:
        """Ids and blocks (_id, _block) of the rows that the terms leave; none if they narrow nothing."""
        rare = {self.rarest(spark, t) for t in terms} - {None}
        chosen = sorted(((n, g) for g, n in rare if n <= COMMON * self.total))
        postings, found = spark.read.schema(POSTING).parquet(f"{self.path}/postings"), None
        for _, g in chosen:
            named = postings.where(_in_buckets([g])).select("_id", "_block")
            found = named if found is None else found.join(named, ["_id", "_block"], "left_semi")
        return found

    def search(self, spark: SparkSession, keyword: str | None = None, power_type: str | None = None,
               confidence_level: str | None = None) -> DataFrame:
        """The rows that `views.search_farms` finds."""
        terms = [t for t in re.split(r"\s+", (keyword or "").strip()) if t]
        found, rows = self.candidates(spark, terms), self.rows(spark)
        if found is not None:
            blocks = [r[0] for r in found.select("_block").distinct().collect()]  # at most one row per block
            rows = rows.where(F.col("_block").isin(blocks)).join(
                found.select(F.col("_id").alias(self.id_column)), self.id_column, "left_semi").select(*rows.columns)
        return views.search_farms(rows.drop("_block"), keyword, power_type, confidence_level)


def _bucket(gram):
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def _in_buckets(grams: list[int]):
    return F.col("bucket").isin(sorted({g % BUCKETS for g in grams})) & F.col("gram").isin(grams)


def build_index(df: DataFrame, columns: tuple[str, ...] = ("enterprise_name", "province"), id_column: str = "id",
                blocks: int | None = None, path: str | None = None) -> SearchIndex:
    """Store rows, postings and the number of rows of every trigram. Ids are unique and not null."""
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch_path(spark, "search")
    index = SearchIndex(path, df.schema, id_column, 0)
    dealt = df.repartitionByRange(blocks, id_column).withColumn("_block", F.spark_partition_id())
    dealt.write.partitionBy("_block").parquet(f"{path}/rows")
    rows = index.rows(spark)
    grams = F.array_distinct(F.concat(*[
        F.coalesce(_grams(fold_case(F.col(c)), F.lit(GRAM)), F.array().cast("array<long>")) for c in columns]))
    postings = rows.select(F.explode(grams).alias("gram"), F.col(id_column).alias("_id"), "_block")
    # by trigram inside a folder, so that row groups are skipped; a trigram of many rows spreads over several files
    ranged = postings.withColumn("bucket", _bucket(F.col("gram"))).repartitionByRange(blocks, "bucket", "gram", "_id")
    ranged.sortWithinPartitions("bucket", "gram", "_id").write.partitionBy("bucket").parquet(f"{path}/postings")
    held = spark.read.schema(POSTING).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("held"))
    held.repartitionByRange(blocks, "bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/held")
    return SearchIndex(path, df.schema, id_column, rows.count())

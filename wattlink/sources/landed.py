"""Landed JSON: list pages, detail documents, geocoder answers and caches, boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattlink import schemas
from wattlink.functions.documents import document
from wattlink.sources.csvio import path_exists


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with source, page and the page body as text."""
    return spark.read.schema(schemas.PAGES).json(path)


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with id and the document body; documents as VARIANT, broken ones dropped."""
    raw = spark.read.schema("id string, body string").json(path)
    return raw.select("id", document(F.col("body")).alias("doc")).where("doc IS NOT NULL")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSES).json(path)


def cache_entries(texts: DataFrame, column: str = "value") -> DataFrame:
    """Cache objects (query -> entry) to one row per query; the key stands in for a missing query
    field. Unreadable text gives no rows."""
    entries = texts.select(F.explode(F.from_json(column, schemas.CACHE_MAP)).alias("key", "entry"))
    fields = [F.coalesce("entry.query", "key").alias("query") if c == "query" else F.col(f"entry.{c}")
              for c in schemas.CACHE_FIELDS]
    return entries.select(*fields)


def read_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A geocode cache: one JSON object per file, or with `lines` one object per line. A missing
    path is an empty cache."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.CACHE_ENTRY)
    return cache_entries(spark.read.text(path, wholetext=not lines))


def cache_lines(cache: DataFrame) -> DataFrame:
    """Each entry as a JSON object of its own, keyed by its query."""
    fields = [c for c in schemas.CACHE_FIELDS if c in cache.columns]
    return cache.select(F.to_json(F.create_map(F.col("query"), F.struct(*fields))).alias("value"))


def write_cache(cache: DataFrame, path: str) -> None:
    """Write the cache as lines of one-key objects, readable with `read_cache(lines=True)`."""
    cache_lines(cache).write.mode("overwrite").text(path)


def write_cache_object(cache: DataFrame, path: str) -> None:
    """Write the cache as one JSON object whose keys are the queries, in parts that follow each other by name; joined
    they are the file that viewers load. Every entry is a line, all but the first led by a comma."""
    entries = cache_lines(cache.where("query IS NOT NULL"))
    first = entries.agg(F.min("value")).first()[0]
    inner = F.substring("value", F.lit(2), F.length("value") - 2)  # without its braces
    opening = "{" + (first[1:-1] if first else "")
    spark = cache.sparkSession
    ends = [spark.createDataFrame([(text,)], "value string").coalesce(1) for text in (opening, "}")]
    others = entries.where(F.col("value") != F.lit(first)).select(F.concat(F.lit(","), inner).alias("value"))
    ends[0].unionByName(others).unionByName(ends[1]).write.mode("overwrite").text(path)


def read_cache_object(spark: SparkSession, path: str) -> DataFrame:
    """A cache written by `write_cache_object`, its parts read in parallel."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^[{,]", "").alias("value")).where("value NOT IN ('', '}')")
    return cache_entries(lines.select(F.concat(F.lit("{"), "value", F.lit("}")).alias("value")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Whole boundary files: path, body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"),
                                                        F.col("value").alias("body"))

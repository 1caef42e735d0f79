"""Incremental ingest of landed pages and resumable enrichment, as Structured Streaming jobs.

Ingest writes one folder per micro-batch and overwrites it when a batch is replayed. Enrichment appends to folders by key hash
and micro-batch: a batch looks for known keys in the folders of its own keys only, writes its own rows only, and
replaces those when it is replayed. A restart after a failure neither loses nor repeats rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wattlink import constants as K, schemas
from wattlink.functions.text import strip
from wattlink.operators import geocode, registry
from wattlink.session import durable
from wattlink.sources.csvio import path_exists


def _batches_before(spark: SparkSession, sink: str, batch_id: int, columns: list[str], parts: list[int] | None = None) -> DataFrame:
    """Columns of the rows that earlier batches wrote, of some key folders or of all."""
    if not path_exists(spark, f"{sink}/*"):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    rows = spark.read.parquet(sink)
    mine = F.lit(True) if parts is None else F.col("part").isin(parts)
    return rows.where((F.col("batch_id") < batch_id) & mine).select(*columns)


def _write_batch(df: DataFrame, sink: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def ingest_pages(spark: SparkSession, landing: str, sink: str, checkpoint: str, sources: dict | list[dict],
                 lookup: dict | None = None, now: str | None = None, available_now: bool = True,
                 max_files: int = 1000) -> StreamingQuery:
    """Extract registry rows of all sources from each landed page as it arrives, in one stream: files are read once
    and every page goes to the rules of its source. `read_registry` gives the deduplicated state."""
    pages = spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", max_files).json(landing)
    listed = [sources] if isinstance(sources, dict) else sources

    def land(batch: DataFrame, batch_id: int) -> None:
        known = batch.where(F.col("source").isin([s["name"] for s in listed])).persist()  # read again for each source
        parts = [registry.extract_registry(registry.page_items(known.where(F.col("source") == s["name"]), s), s, lookup, now)
                 for s in listed]
        _write_batch(reduce(DataFrame.unionByName, parts), sink, batch_id)
        known.unpersist()

    writer = pages.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_registry(spark: SparkSession, sink: str) -> DataFrame:
    """Current registry of an ingest sink: newest row per key."""
    return registry.latest_records(spark.read.parquet(sink).select(*K.REGISTRY_COLUMNS))


PARTS = 64


def key_part() -> Column:
    """Folder of a row by its key columns, as `skip_processed` compares them."""
    return F.pmod(F.xxhash64(*[strip(c) for c in geocode.ROW_KEY]), F.lit(PARTS)).cast("int")


def waiting_rows(spark: SparkSession, sink: str, batch_id: int = 1 << 62) -> DataFrame:
    """Rows that came back pending in an earlier batch and have not been answered since."""
    asked = _batches_before(spark, f"{sink}-pending", batch_id, K.STRUCTURED_COLUMNS)
    return geocode.skip_processed(asked, _batches_before(spark, sink, batch_id, geocode.ROW_KEY))


def _append(df: DataFrame, sink: str, batch_id: int) -> None:
    placed = df.withColumns({"part": key_part(), "batch_id": F.lit(batch_id).cast("long")})
    if not path_exists(df.sparkSession, f"{sink}/*"):  # an empty file makes the sink readable
        placed.where("false").drop("part", "batch_id").coalesce(1).write.mode("overwrite").parquet(f"{sink}/part=-1/batch_id=-1")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch_id").parquet(sink)


def _land_answered(spark: SparkSession, rows: DataFrame, waiting: DataFrame, sink: str, batch_id: int, enrich) -> None:
    """Answered rows go to the sink; rows that are pending for the first time are kept apart, to be asked again."""
    both = durable(rows.unionByName(waiting))
    parts = [r[0] for r in both.select(key_part()).distinct().collect()]  # at most PARTS
    done = _batches_before(spark, sink, batch_id, geocode.ROW_KEY, parts)
    enriched = durable(enrich(geocode.skip_processed(both, done)))
    open_ = F.col("地理编码状态") == geocode.PENDING if "地理编码状态" in enriched.columns else F.lit(False)
    _append(enriched.where(~open_), sink, batch_id)
    known = _batches_before(spark, f"{sink}-pending", batch_id, geocode.ROW_KEY, parts)
    _append(geocode.skip_processed(enriched.where(open_).select(*K.STRUCTURED_COLUMNS), known), f"{sink}-pending", batch_id)


def resume_enrichment(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                      enrich: Callable[[DataFrame], DataFrame], available_now: bool = True,
                      max_files: int = 1000) -> StreamingQuery:
    """Enrich structured rows that are not in the sink yet; known row keys are skipped. Rows that come
    back pending are not in the sink: every later batch asks them again, and `retry_pending` does so
    without new input."""
    rows = spark.readStream.schema(schemas.STRUCTURED).option("maxFilesPerTrigger", max_files).parquet(landing)

    def process(batch: DataFrame, batch_id: int) -> None:
        _land_answered(spark, batch, waiting_rows(spark, sink, batch_id), sink, batch_id, enrich)

    writer = rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def retry_pending(spark: SparkSession, sink: str, enrich: Callable[[DataFrame], DataFrame]) -> None:
    """Ask the rows that are still pending once more, between runs of the stream. Rows already in the sink are
    skipped, so a repeated call adds nothing twice. Its folders are numbered below those of all batches."""
    waiting = waiting_rows(spark, sink)
    answered = durable(enrich(waiting))
    _append(answered.where(F.col("地理编码状态") != geocode.PENDING), sink, -time.time_ns())

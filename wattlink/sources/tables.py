"""Stored tables: Parquet snapshots that are replaced as a whole, and tables by key whose touched folders are."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wattlink import schemas
from wattlink.operators.imports import upsert
from wattlink.session import stored
from wattlink.sources.csvio import path_exists

TABLES = {
    "power_fields": schemas.POWER_FIELDS,
    "recognition": schemas.RECOGNITION,
    "manual_associations": schemas.MANUAL_ASSOCIATIONS,
}
PARTITIONS = {"recognition": ["energy_type"]}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Older layouts to the current one: columns that are missing become null."""
    def column(f: T.StructField):
        return (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def _versions(spark: SparkSession, root: str, name: str) -> list[str]:
    pattern = f"{root}/{name}/v-*/_SUCCESS"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(str(s.getPath().getParent()) for s in (found or []))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Newest complete snapshot of a table; an empty table if there is none."""
    versions = _versions(spark, root, name)
    if not versions:
        return empty_table(spark, name)
    return conform(spark.read.schema(TABLES[name]).parquet(versions[-1]), TABLES[name])


def write_table(df: DataFrame, root: str, name: str) -> str:
    """Write a new snapshot next to the old ones. Readers switch once its success marker exists,
    so a failed write changes nothing and the snapshot being read is never overwritten."""
    path = f"{root}/{name}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = conform(df, TABLES[name]).write.mode("errorifexists")
    if name in PARTITIONS:
        writer = writer.partitionBy(*PARTITIONS[name])
    writer.parquet(path)
    return path


# --- tables kept by key ------------------------------------------------------------------------
#
# Rows lie in folders by the hash of their key. An import rewrites the folders that hold keys of the file and
# leaves the files of all others as they are. Each folder is replaced as Spark commits the job; an import that
# was cut off there is run again, which gives the same rows.

KEYS = {
    "power_fields": ["enterprise_name"],
    "recognition": ["energy_type", "original_image"],
    "manual_associations": ["energy_type", "farm_id", "recognition_id"],
}
FOLDERS = 64


def key_folder(keys: list[str], folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")


def _put_by_key(df: DataFrame, root: str, name: str, folders: int) -> None:
    placed = conform(df, TABLES[name]).withColumn("folder", key_folder(KEYS[name], folders))
    # one file a folder: the shuffle that an import needs anyway deals by folder
    placed.repartition(folders, "folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "folder").parquet(f"{root}/{name}-by-key")


def write_by_key(df: DataFrame, root: str, name: str, folders: int = FOLDERS) -> None:
    """Start a table that is kept by key."""
    _put_by_key(df, root, name, folders)


def read_by_key(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}-by-key"
    if not path_exists(spark, f"{path}/folder=*"):
        return empty_table(spark, name).withColumn("folder", F.lit(0))
    schema = T.StructType([*TABLES[name].fields, T.StructField("folder", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def upsert_by_key(spark: SparkSession, root: str, name: str, incoming: DataFrame, now: str, row_no: str = "row_no",
                  refresh_only: bool = False, folders: int = FOLDERS) -> list[int]:
    """Merge incoming rows into the folders of their keys; the folders that were rewritten. Of all other folders only the
    ids are read, for the greatest one."""
    keys = KEYS[name]
    whole = read_by_key(spark, root, name)
    touched = sorted(r[0] for r in incoming.select(key_folder(keys, folders)).distinct().collect())  # at most `folders`
    mine = whole.where(F.col("folder").isin(touched)).drop("folder")
    top = whole.agg(F.max("id")).first()[0] or 0
    # written aside first: the folders that it reads are replaced
    state = stored(upsert(mine, incoming, keys, now, row_no, refresh_only, top), "upserted")
    if touched:
        _put_by_key(state, root, name, folders)
    return touched


def load_sources(path: str) -> dict:
    """A source configuration file: sources with their APIs and extraction mappings."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


__all__ = ["conform", "empty_table", "load_sources", "path_exists", "read_by_key", "read_table", "upsert_by_key", "write_by_key",
           "write_table"]

"""Image inventories: which files exist."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattlink.session import durable, ship

_SCHEMA = pa.schema([("path", pa.string()), ("name", pa.string()), ("folder", pa.bool_())])


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system of a path, the path in it, and what stands before that in the path as given."""
    local = re.match("file:/+", path)
    if local or "://" not in path:
        inside = "/" + path[local.end():] if local else os.path.abspath(path)
        return pafs.LocalFileSystem(), inside, "file:" if local else ""
    uri = re.sub("^s3[an]://", "s3://", path)
    system, inside = pafs.FileSystem.from_uri(uri)
    return system, inside, path[:path.index("://") + 3] if path.startswith("s3") else re.match("[^:]+://[^/]*", path).group()


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and folders directly in each folder, without those whose names start with a point."""
    for b in batches:
        for folder in b.column(0).to_pylist():
            system, inside, before = opened(folder)
            entries = system.get_file_info(pafs.FileSelector(inside, allow_not_found=True))
            rows = []
            for e in entries:
                name = e.base_name
                # a link to a folder counts as a file, so that links cannot lead in circles
                linked = isinstance(system, pafs.LocalFileSystem) and os.path.islink(e.path)
                if not name.startswith("."):
                    rows.append({"path": before + e.path, "name": name, "folder": e.type == pafs.FileType.Directory and not linked})
            for begin in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[begin:begin + 10_000], _SCHEMA)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder: path and name. Only names are read, no contents.

    Folders are listed level by level, those of one level by many tasks; each level is checkpointed. Files
    and folders with a leading '.' are left out; empty files and names that start with '_' count. A folder
    that does not exist has no files. Works on folders that every executor reaches by `pyarrow.fs`.
    """
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(folder,)], "path string")
    files = None
    while True:
        listed = durable(level.mapInArrow(_children, "path string, name string, folder boolean"))
        found = listed.where("NOT folder").select("path", "name")
        files = found if files is None else files.unionByName(found)
        folders = listed.where("folder").select("path")
        if folders.isEmpty():
            return files
        level = folders.repartition(tasks, "path")


def landed_images(inventory: DataFrame, path: str = "path") -> DataFrame:
    """The same from a landed inventory, a table with one path a row: paths with a name or folder that
    starts with '.' are left out, as are null and repeated ones."""
    rows = inventory.select(F.col(path).alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"))
    return rows.where(~F.col("path").rlike(r"(^|/)\.[^/]*") & (F.col("name") != "")).distinct()


def image_names(files: DataFrame) -> DataFrame:
    """One row per file name; of several paths the greatest."""
    return files.groupBy("name").agg(F.max("path").alias("path"))

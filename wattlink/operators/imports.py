"""Validated bulk imports, upserts and deletes. Each returns the new state of a table; writing it
is a snapshot swap (sources.tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlink import constants as K
from wattlink.functions.measure import finite_number, province_of_code
from wattlink.functions.text import JS_SPACE, strip, text
from wattlink.operators.ranking import numbered
from wattlink.session import stored


MISSING_FIELDS = "导入文件格式不正确，缺少识别数据必要字段"


class ImportRejected(ValueError):
    """The import file as a whole was refused."""


def alias_of(columns: list[str], energy_type: str, field: str) -> str | None:
    """First header alias present, whether or not its cells are filled."""
    return next((a for a in K.RECOGNITION_ALIASES[energy_type][field] if a in columns), None)


def recognition_fields(rows: DataFrame, energy_type: str, keep: list[str] | None = None) -> DataFrame:
    """Logical recognition columns from whichever header names the file uses; trimmed text."""
    def field(name):
        found = alias_of(rows.columns, energy_type, name)
        return (strip(F.col(f"`{found}`"), JS_SPACE) if found else F.lit("")).alias(name)

    return rows.select(*(keep or []), *[field(f) for f in K.RECOGNITION_ALIASES[energy_type]])


def check_headers(rows: DataFrame, kind: str) -> None:
    """Refuse files without rows, farm files that lack a header, recognition files whose header
    lacks a required field."""
    if rows.isEmpty():
        raise ImportRejected("导入文件没有可导入的数据行")
    if kind == "power-fields":
        missing = [c for c in K.FARM_IMPORT_COLUMNS if c not in rows.columns]
        if missing:
            raise ImportRejected(f"导入文件格式不正确，缺少字段: {'、'.join(missing)}")
    elif any(alias_of(rows.columns, kind.split("-")[0], f) is None for f in K.RECOGNITION_REQUIRED):
        raise ImportRejected(MISSING_FIELDS)


def with_first_problem(rows: DataFrame, kind: str) -> DataFrame:
    """Add `missing_field`: the first required field a row leaves empty, null for good rows."""
    if kind == "power-fields":
        required = {"企业名称": strip("企业名称", JS_SPACE)}
    else:
        energy = kind.split("-")[0]
        required = {}
        for f in K.RECOGNITION_REQUIRED:
            found = alias_of(rows.columns, energy, f)
            required[f] = strip(F.col(f"`{found}`"), JS_SPACE) if found else F.lit("")
    return rows.withColumn("missing_field", F.coalesce(*[F.when(c == "", F.lit(f)) for f, c in required.items()]))


def validate_import(rows: DataFrame, kind: str, row_no: str = "row_no") -> DataFrame:
    """All or nothing: the rows, or `ImportRejected` naming the first bad row and field. A recognition
    file whose first row leaves a required field empty is refused for its format."""
    check_headers(rows, kind)
    problem = F.when(F.col("missing_field").isNotNull(), F.struct(row_no, "missing_field"))
    opening, bad = with_first_problem(rows, kind).agg(F.min(row_no), F.min(problem)).first()
    if bad is not None and kind != "power-fields" and bad[0] == opening:
        raise ImportRejected(MISSING_FIELDS)
    if bad is not None:
        raise ImportRejected(f"第 {bad[0]} 行缺少必填字段: {bad[1]}")
    return rows


def farm_rows(rows: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Imported farm columns to stored ones; an unreadable confidence becomes 0."""
    return rows.select(
        row_no,
        *[text(F.col(f"`{c}`")).alias(field) for c, field in K.FARM_FIELD_OF_COLUMN.items()],
        F.coalesce(finite_number(F.col("`经纬度可信度`")), F.lit(0.0)).alias("confidence"),
    )


def recognition_rows(rows: DataFrame, energy_type: str, inventory: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Imported points to stored columns, with province name and the image-exists flag."""
    f = recognition_fields(rows, energy_type, [row_no])
    files = inventory.select(F.col("name").alias("original_image"), F.lit(1).alias("_file")).dropDuplicates()
    return f.join(files, "original_image", "left").select(
        row_no, F.lit(energy_type).alias("energy_type"), "original_image", F.col("province").alias("province_code"),
        province_of_code("province").alias("province_name"), "city", "longitude", "latitude", "poi",
        F.coalesce("_file", F.lit(0)).alias("image_exists"),
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], now: str, row_no: str = "row_no",
           refresh_only: bool = False, top: int | None = None) -> DataFrame:
    """New state of `current` after the incoming rows in file order. `top` is the greatest id in use, where
    `current` is a part of a table.

    The last row of a key wins. Known keys keep id and created_at and take every other incoming
    column; new keys get the next ids in the order of their first row. With `refresh_only`
    existing rows change nothing but updated_at.
    """
    fields = [c for c in incoming.columns if c not in (*keys, row_no)]
    newest = F.max_by(F.struct(*fields), F.col(row_no)).alias("_row") if fields else F.lit(None).alias("_row")
    # both branches below read it
    last = stored(incoming.groupBy(*keys).agg(newest, F.min(row_no).alias("_opening")).select(
        *keys, *[F.col(f"_row.{c}") for c in fields], "_opening"), "incoming")
    values = [c for c in current.columns if c not in (*keys, "id", "created_at", "updated_at")]
    # known keys: a left join, which keeps every current row; new ones: an anti join on the keys alone
    touched = F.col("n._new").isNotNull()
    joined = current.alias("o").join(last.withColumn("_new", F.lit(True)).alias("n"), keys, "left")

    def value(c):
        if refresh_only or c not in last.columns:
            return F.col(f"o.{c}")
        return F.when(touched, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    known = joined.select(
        F.col("o.id").alias("id"), *keys, *[value(c).alias(c) for c in values],
        F.coalesce("o.created_at", F.lit(now)).alias("created_at"),
        F.when(touched, F.lit(now)).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )
    if top is None:
        top = current.agg(F.max("id")).first()[0] or 0
    fresh = last.join(current.select(*keys), keys, "left_anti").select(
        "_opening", *keys, *[(F.col(c) if c in last.columns else F.lit(None).cast(current.schema[c].dataType)).alias(c) for c in values],
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    numbered_fresh = numbered(fresh, [F.col("_opening")], name="id", start=top + 1).drop("_opening")
    return known.unionByName(numbered_fresh).select(*current.columns)


def import_farms(current: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    return upsert(current, farm_rows(validate_import(rows, "power-fields")), ["enterprise_name"], now)


def import_points(current: DataFrame, rows: DataFrame, energy_type: str, inventory: DataFrame, now: str) -> DataFrame:
    good = validate_import(rows, f"{energy_type}-recognition")
    return upsert(current, recognition_rows(good, energy_type, inventory), ["energy_type", "original_image"], now)


def add_manual_links(current: DataFrame, requested: DataFrame, farms: DataFrame, points: DataFrame, now: str,
                     row_no: str = "row_no") -> DataFrame:
    """Upsert (energy_type, farm_id, recognition_id): ids must be positive, the farm and the point
    must exist; on a known link only updated_at changes."""
    valid = requested.where("farm_id > 0 AND recognition_id > 0 AND energy_type IN ('wind', 'solar')")
    valid = valid.join(farms.select(F.col("id").alias("farm_id")), "farm_id", "left_semi")
    known = points.select("energy_type", F.col("id").alias("recognition_id"))
    valid = valid.join(known, ["energy_type", "recognition_id"], "left_semi")
    keys = ["energy_type", "farm_id", "recognition_id"]
    return upsert(current, valid.select(row_no, *keys), keys, now, row_no, refresh_only=True)


def delete_where(df: DataFrame, condition: Column | None) -> DataFrame:
    """Rows left after deleting those that meet the condition; no condition deletes all. Rows for
    which the condition is unknown stay."""
    if condition is None:
        return df.where(F.lit(False))
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_points_without_image(points: DataFrame, inventory: DataFrame, condition: Column | None = None) -> DataFrame:
    """Delete points whose image file is missing, within the condition."""
    files = inventory.select(F.col("name").alias("original_image"), F.lit(True).alias("_file")).dropDuplicates()
    chosen = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return points.join(files, "original_image", "left").where(
        F.coalesce("_file", F.lit(False)) | ~chosen
    ).select(*points.columns)


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not among `keys` (manual links by type, farm and point; rows by id)."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")

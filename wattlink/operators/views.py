"""Searches, filters and pages over the stored tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wattlink import constants as K
from wattlink.functions.measure import finite_number
from wattlink.functions.text import blank_to_null, like_any_case
from wattlink.operators.ranking import computed_once


def energy_match(energy_type: str) -> Column:
    """Power types of the energy type; any type but wind counts as solar."""
    return F.col("power_type").isin(K.ENERGY_POWER_TYPES["wind" if energy_type == "wind" else "solar"])


def province_match(column: str, province: str) -> Column:
    """Column names the province: a known short name is contained as it is, since every full name
    begins with it; any other text keeps LIKE rules."""
    if province in K.PROVINCES:
        return F.col(column).contains(province)
    return like_any_case(F.col(column), province)


def province_like(province: str) -> Column:
    return like_any_case(F.col("province_name"), province) | like_any_case(F.col("province_code"), province)


def confidence_match(level: str | None) -> Column | None:
    c = F.col("confidence")
    return {"high": c >= 0.9, "medium": (c >= 0.8) & (c < 0.9), "low": c < 0.8}.get(level)


def confidence_band(c: str = "confidence") -> Column:
    return F.when(F.col(c) >= 0.9, "high").when(F.col(c) >= 0.8, "medium").when(F.col(c) < 0.8, "low")


def farm_condition(keyword: str | None = None, power_type: str | None = None,
                   confidence_level: str | None = None) -> Column | None:
    """Filter of the farm list: every keyword in name or province, the power type, the band."""
    terms = [t for t in re.split(r"\s+", (keyword or "").strip()) if t]
    clauses = [
        like_any_case(F.col("enterprise_name"), t) | like_any_case(F.col("province"), t) for t in terms
    ]
    if (power_type or "").strip():
        clauses.append(like_any_case(F.col("power_type"), power_type.strip()))
    band = confidence_match(confidence_level)
    if band is not None:
        clauses.append(band)
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def search_farms(df: DataFrame, keyword: str | None = None, power_type: str | None = None,
                 confidence_level: str | None = None) -> DataFrame:
    condition = farm_condition(keyword, power_type, confidence_level)
    return df if condition is None else df.where(condition)


def recognition_view(points: DataFrame, inventory: DataFrame, province: str | None = None,
                     unlinked_only: bool = False) -> DataFrame:
    """Points with their image link by the file inventory (name); optionally only those without."""
    from wattlink.operators.association import image_url

    rows = points.where(province_like(province)) if province else points
    if unlinked_only:
        missing = rows.join(inventory.select(F.col("name").alias("original_image")), "original_image", "left_anti")
        return missing.withColumn("image_url", F.lit(None).cast("string"))
    files = inventory.select(F.col("name").alias("original_image"), F.lit(True).alias("_file")).dropDuplicates()
    url = image_url(F.col("energy_type"), F.col("original_image"))
    return rows.join(files, "original_image", "left").withColumn("image_url", F.when(F.col("_file"), url)).drop("_file")


def page(df: DataFrame, page_no: int = 1, size: int = 10, key: str = "id") -> DataFrame:
    """One page in falling key order. Deep pages are better read with `page_after`."""
    return df.orderBy(F.desc(key)).offset((page_no - 1) * size).limit(size)


def page_after(df: DataFrame, last, size: int = 10, key: str = "id") -> DataFrame:
    """The page that follows the row with key `last`."""
    return df.where(F.col(key) < last).orderBy(F.desc(key)).limit(size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


# --- geocode cache -----------------------------------------------------------------------------


def cache_successes(cache: DataFrame) -> DataFrame:
    """Successful cache entries whose coordinates are given."""
    return cache.where("status = 'success' AND lon <> '' AND lat <> ''")


def shown_power_type() -> Column:
    return F.coalesce(blank_to_null(F.col("power_type")), F.lit(K.UNLABELLED))


def visible_entries(cache: DataFrame, power_types: list[str] | None = None) -> DataFrame:
    """Drawable entries of the chosen power types, coordinates as numbers."""
    chosen = K.DEFAULT_VISIBLE_TYPES if power_types is None else power_types
    placed = computed_once(cache_successes(cache), lng=finite_number("lon"), lat=finite_number("lat"))
    return placed.where("lng IS NOT NULL AND lat IS NOT NULL").where(shown_power_type().isin(chosen))


def cache_counts(cache: DataFrame) -> DataFrame:
    ok = (F.col("status") == "success") & (F.col("lon") != "") & (F.col("lat") != "")
    return cache.agg(F.count("*").alias("total_entries"), F.count_if(ok).alias("success_entries"))


def power_type_counts(cache: DataFrame) -> DataFrame:
    return cache_successes(cache).groupBy(shown_power_type().alias("power_type")).agg(F.count("*").alias("entries"))


def in_locale_order(df: DataFrame, column: str = "power_type") -> DataFrame:
    """Order by Chinese (pinyin) collation."""
    return df.orderBy(F.collate(column, "zh"))


def bounds(df: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    return df.agg(
        F.min(lng).alias("min_lng"), F.min(lat).alias("min_lat"), F.max(lng).alias("max_lng"),
        F.max(lat).alias("max_lat"),
    )

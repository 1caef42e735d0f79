"""Place names of points from landed reverse-geocoder answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattlink import constants as K
from wattlink.functions.documents import as_text, document, value_at
from wattlink.functions.text import blank_to_null, strip, text
from wattlink.operators.ranking import computed_once, first_per_key


def parse_reverse(responses: DataFrame) -> DataFrame:
    """Answers (lng, lat, body) to (lng, lat, poi): the first place name if any place is listed,
    else the address component's poi, town or county; '' where the lookup failed."""
    doc = F.col("_doc")
    named = lambda path: strip(as_text(value_at(doc, path)))
    pois = value_at(doc, "result.pois", "array<variant>")
    component = F.coalesce(*[
        blank_to_null(named(f"result.addressComponent.{k}")) for k in ("poi", "town", "county")
    ])
    poi = F.when(F.coalesce(as_text(value_at(doc, "status")), F.lit("")) != "0", "").when(
        F.size(pois) > 0, named("result.pois.0.name")
    ).otherwise(text(component))
    return computed_once(responses, _doc=document(F.col("body"))).select(strip("lng").alias("lng"), strip("lat").alias("lat"), text(poi).alias("poi"))


def pending_lookups(points: DataFrame, lookup: DataFrame) -> DataFrame:
    """Distinct coordinate texts still without an answer."""
    pairs = points.select(strip("经度").alias("lng"), strip("纬度").alias("lat")).where("lng <> '' AND lat <> ''")
    return pairs.dropDuplicates().join(lookup, ["lng", "lat"], "left_anti")


def reverse_poi(points: DataFrame, lookup: DataFrame, newest: str | None = None) -> DataFrame:
    """Points with the POI of their exact coordinate texts; '' for blank or unknown ones. Of several answers that
    with the largest column `newest` holds, among these or without such a column the smallest text."""
    missing = [c for c in K.POI_INPUT_COLUMNS if c not in points.columns]
    if missing:
        raise ValueError(f"缺少字段: {', '.join(missing)}")
    p = computed_once(points.select(*[strip(c).alias(c) for c in K.POI_INPUT_COLUMNS]))
    asked = (F.col("经度") != "") & (F.col("纬度") != "")
    # blank coordinates are a hot key that can never match: they get no join key
    p = p.withColumns({"_lng": F.when(asked, F.col("经度")), "_lat": F.when(asked, F.col("纬度"))})
    answers = lookup.select(F.col("lng").alias("_lng"), F.col("lat").alias("_lat"), "poi", *([F.col(newest).alias("_at")] if newest else []))
    found = first_per_key(answers, ["_lng", "_lat"], [*([F.desc_nulls_last("_at")] if newest else []), F.asc_nulls_last("poi")]).select("_lng", "_lat", "poi")
    return p.join(found, ["_lng", "_lat"], "left").select(*K.POI_INPUT_COLUMNS, text("poi").alias("POI"))

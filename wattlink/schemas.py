"""Explicit schemas of stored tables and of the JSON structures that travel between jobs."""

from pyspark.sql import types as T

from wattlink import constants as K


def _text(names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


REGISTRY = _text(K.REGISTRY_COLUMNS)
STRUCTURED = _text(K.STRUCTURED_COLUMNS)
GEOCODED = _text(K.FARM_IMPORT_COLUMNS)
POI = _text(K.POI_OUTPUT_COLUMNS)

POWER_FIELDS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in K.FARM_FIELD_OF_COLUMN.values()]
    + [
        T.StructField("confidence", T.DoubleType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)
RECOGNITION = T.StructType(
    [
        T.StructField("energy_type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("original_image", T.StringType()),
        T.StructField("province_code", T.StringType()),
        T.StructField("province_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("longitude", T.StringType()),
        T.StructField("latitude", T.StringType()),
        T.StructField("poi", T.StringType()),
        T.StructField("image_exists", T.IntegerType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)
MANUAL_ASSOCIATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("energy_type", T.StringType()),
        T.StructField("farm_id", T.LongType()),
        T.StructField("recognition_id", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)
CACHE_FIELDS = [
    "status", "message", "lon", "lat", "level", "query", "candidate_level", "original_address",
    "standard_address", "company_name", "site_name", "region", "power_type",
]
CACHE_ENTRY = _text(CACHE_FIELDS)
CACHE_MAP = T.MapType(T.StringType(), CACHE_ENTRY)
PAGES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("page", T.LongType()),
        T.StructField("body", T.StringType()),
    ]
)
RESPONSES = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)
POINT = T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])

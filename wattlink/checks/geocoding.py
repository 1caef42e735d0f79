"""Queries about geocoding, reverse geocoding and the geocode cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlink import constants as K, schemas
from wattlink.checks.addresses import structured, structured_ctes
from wattlink.checks.fixtures import duck_ctes, spark_view
from wattlink.operators import geocode as G, reverse, views
from wattlink.operators.ranking import in_read_order
from wattlink.session import durable, scratch_path, stored
from wattlink.sources import csvio, landed

# the answer to a query follows from its text: long ones fail, middling ones succeed, short ones
# have not been asked yet
ASKED = "length(query) >= 8"
SUCCEEDS = "length(query) <= 16"
LON = "CAST(90 + length(query) AS STRING)"
POWER = """CASE WHEN query LIKE '%县%' THEN '风电' WHEN query LIKE '%镇%' THEN '太阳能发电' WHEN query LIKE '%公司%' THEN ''
    ELSE '水电' END"""


def _written(spark, sf_dir):
    """Structured rows as a job finds them: written once, read by every step."""
    return durable(structured(spark, sf_dir))


def _cache(spark, sf_dir, rows=None):
    rows = structured(spark, sf_dir) if rows is None else rows
    asked = G.geocode_candidates(rows, ["id"]).select("query").distinct().where(ASKED)
    good = F.expr(SUCCEEDS)
    return asked.select(
        "query", F.when(good, "success").otherwise("failed").alias("status"),
        F.when(good, "OK").otherwise("no result").alias("message"),
        F.when(good, F.expr(LON)).alias("lon"), F.when(good, F.lit("25.5")).alias("lat"),
        F.when(good, F.lit("地名")).alias("level"), F.expr(POWER).alias("power_type"),
    )


def geocode_candidates(spark, sf_dir):
    return G.geocode_candidates(structured(spark, sf_dir), ["id"])


def geocode_resolve(spark, sf_dir):
    rows = _written(spark, sf_dir)
    return G.geocode_resolve(rows, _cache(spark, sf_dir, rows)).select("id", *K.GEOCODE_COLUMNS)


def geocode_pending(spark, sf_dir):
    rows = _written(spark, sf_dir)
    return G.geocode_pending(rows, _cache(spark, sf_dir, rows))


def geocode_enrich_cache(spark, sf_dir):
    rows = _written(spark, sf_dir)
    return G.enrich_cache(_cache(spark, sf_dir, rows), rows, "id").select(
        "query", "status", "lon", "candidate_level", "company_name", "standard_address", "original_address", "site_name",
        "region", "power_type")


def _answers(pending):
    body = F.when(F.col("query").contains("公司"), '{"status":"404","msg":""}').when(
        F.col("query").contains("站"), '{"status":"0","msg":"ok","location":{"lon":"","lat":1}}'
    ).otherwise(F.concat(F.lit('{"status":"0","msg":"ok","location":{"lon":'), F.length("query") + 100,
                         F.lit(',"lat":30.25,"level":"村"}}')))
    return pending.select("query", F.lit(200).alias("http_status"), body.alias("body"))


def geocode_cascade(spark, sf_dir):
    rows = _written(spark, sf_dir)
    # every wave looks into the cache: written once
    rows, _ = G.cascade(rows, stored(_cache(spark, sf_dir, rows), "cache"), _answers)
    return rows.select("id", *K.GEOCODE_COLUMNS)


def geocode_resume(spark, sf_dir):
    rows = _written(spark, sf_dir)
    done = rows.where(F.col("企业名称").contains("某公司"))
    return G.skip_processed(rows, done, "id").select("id", *G.ROW_KEY)


# landed answers of a geocoder, one per event
RESPONSES = """
SELECT event_id, CAST(event_id AS STRING) AS query, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS http_status,
    CASE event_type WHEN 'error' THEN CONCAT('busy ', CAST(user_id AS STRING))
        WHEN 'click' THEN CONCAT('{"status":"0","msg":"ok","location":{"lon":', CAST(value AS STRING), ',"lat":"25.5","level":"县"}}')
        WHEN 'view' THEN CONCAT('{"status":"', CAST(user_id AS STRING), '","msg":""}')
        WHEN 'purchase' THEN '{"status":0,"location":{"lon":101.5,"lat":25.25}}'
        ELSE '{"status":"0","msg":"ok","location":null}' END AS body, event_type, user_id, value
FROM @events@
"""


def geocode_responses(spark, sf_dir):
    return G.parse_responses(spark_view(spark, sf_dir, RESPONSES))


# landed answers of a reverse geocoder, one per distinct coordinate pair of the wind points
REVERSE = """
SELECT DISTINCT longitude AS lng, latitude AS lat, CASE
    WHEN latitude < '23' THEN CONCAT('{"status":"0","result":{"pois":[{"name":" 村', substr(latitude, 1, 2), ' "}],"addressComponent":{"poi":"x"}}}')
    WHEN latitude < '25' THEN '{"status":"0","result":{"pois":[],"addressComponent":{"poi":" ","town":"某镇","county":"某县"}}}'
    WHEN latitude < '27' THEN '{"status":"404"}'
    ELSE '{"status":"0","result":{"addressComponent":{"county":"某县"}}}' END AS body
FROM points_view WHERE longitude <> '' AND latitude <> '' AND energy_type = 'wind'
"""


def _points(spark, sf_dir):
    return csvio.recognition_export(spark_view(spark, sf_dir, "points"))


def _lookup(spark, sf_dir):
    points = spark_view(spark, sf_dir, "points").where("longitude <> '' AND latitude <> '' AND energy_type = 'wind'")
    body = REVERSE[REVERSE.index("CASE"):REVERSE.index(" AS body")]
    answers = points.select(F.col("longitude").alias("lng"), F.col("latitude").alias("lat"), F.expr(body).alias("body"))
    return reverse.parse_reverse(answers.distinct())


def reverse_poi(spark, sf_dir):
    return reverse.reverse_poi(_points(spark, sf_dir), _lookup(spark, sf_dir))


def reverse_pending(spark, sf_dir):
    return reverse.pending_lookups(_points(spark, sf_dir), _lookup(spark, sf_dir))


def cache_stats(spark, sf_dir):
    return views.cache_counts(_cache(spark, sf_dir))


def cache_power_types(spark, sf_dir):
    return views.in_locale_order(views.power_type_counts(_cache(spark, sf_dir)))


def cache_bounds(spark, sf_dir):
    return views.bounds(views.visible_entries(_cache(spark, sf_dir)))


def cache_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "cache")
    landed.write_cache(_cache(spark, sf_dir), path)
    return landed.read_cache(spark, path, lines=True).select(*schemas.CACHE_FIELDS[:6])


def cache_object(spark, sf_dir):
    """The cache as one JSON object in parts, read back."""
    path = scratch_path(spark, "cache-object")
    # read for its first entry and for all others: written once
    landed.write_cache_object(stored(_cache(spark, sf_dir), "cache"), path)
    return landed.read_cache_object(spark, path).select(*schemas.CACHE_FIELDS[:6])


def power_types_in_order(spark, sf_dir):
    """Power types of the cache with their place in pinyin order."""
    listed = views.in_locale_order(views.power_type_counts(_cache(spark, sf_dir)))
    return in_read_order(listed, "place").select("power_type", "entries", "place")


# --- the same rules in SQL ---------------------------------------------------------------------

_PARTS = ["省", "市州", "区县", "乡镇街道", "村社区", "组社", "门牌号"]
_TEXTS = ["标准化地址", *["concat(" + ", ".join(_PARTS[:n]) + ")" for n in (7, 6, 5, 4, 3)], "concat(省, 原始地址片段)",
          "concat(省, 市州, 区县, 乡镇街道, 站点名称)", "concat(省, 主体名称, 站点名称)", "concat(地区, 站点名称)"]
_LEVELS = list(K.LEVEL_CONFIDENCE)
CANDS = " UNION ALL ".join(
    f"SELECT id, {i} AS rank, '{level}' AS level, {t} AS query, '{K.LEVEL_CONFIDENCE[level]}' AS confidence "
    f"FROM structured WHERE {t} <> ''" for i, (level, t) in enumerate(zip(_LEVELS, _TEXTS), start=1))
CACHE = f"""SELECT query, CASE WHEN {SUCCEEDS} THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN {SUCCEEDS} THEN 'OK' ELSE 'no result' END AS message, CASE WHEN {SUCCEEDS} THEN {LON} END AS lon,
    CASE WHEN {SUCCEEDS} THEN '25.5' END AS lat, CASE WHEN {SUCCEEDS} THEN '地名' END AS level, {POWER} AS power_type
    FROM (SELECT DISTINCT query FROM cands WHERE {ASKED})"""
TRIED = """SELECT c.id, c.rank, c.level, c.query, c.confidence, k.status, k.message, k.lon, k.lat, k.query IS NOT NULL AS cached,
    coalesce(k.status = 'success', false) AS success FROM cands c LEFT JOIN cache k USING (query)"""


def _sql(select, **more):
    return duck_ctes("companies", **structured_ctes(), cands=CANDS, cache=CACHE, tried=TRIED, **more) + "\n" + select


RESOLVED = """SELECT s.id, coalesce(query, '') AS 查询地址, CASE WHEN success THEN lon ELSE '' END AS 经度,
    CASE WHEN success THEN lat ELSE '' END AS 纬度, coalesce(level, '') AS 定位级别, coalesce(confidence, '') AS 经纬度可信度,
    CASE WHEN success THEN 'success' WHEN NOT cached THEN 'pending' ELSE 'failed' END AS 地理编码状态,
    CASE WHEN query IS NULL THEN 'no candidate query' ELSE coalesce(message, '') END AS 地理编码消息
    FROM structured s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY success OR NOT cached DESC,
        CASE WHEN success OR NOT cached THEN rank ELSE -rank END) AS rn FROM {tried}) t ON t.id = s.id AND rn = 1"""
# every query a wave can ask, with the answer it gets
ANSWERED = """SELECT id, rank, level, query, confidence, true AS cached,
    CASE WHEN tried.cached THEN status WHEN query LIKE '%公司%' OR query LIKE '%站%' THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN cached THEN message WHEN query LIKE '%公司%' THEN '404' WHEN query LIKE '%站%' THEN 'missing location' ELSE 'ok' END
        AS message,
    CASE WHEN cached THEN lon ELSE CAST(length(query) + 100 AS VARCHAR) END AS lon,
    CASE WHEN cached THEN lat ELSE '30.25' END AS lat,
    CASE WHEN cached THEN success ELSE NOT (query LIKE '%公司%' OR query LIKE '%站%') END AS success FROM tried"""
ABOUT = "s.企业名称 AS company_name, s.标准化地址 AS standard_address, s.原始地址片段 AS original_address, s.站点名称 AS site_name, s.地区 AS region"
LOOKUP = """SELECT lng, lat, CASE WHEN lat < '23' THEN '村' || substr(lat, 1, 2) WHEN lat < '25' THEN '某镇' WHEN lat < '27' THEN ''
    ELSE '某县' END AS poi FROM (SELECT DISTINCT longitude AS lng, latitude AS lat FROM points
    WHERE longitude <> '' AND latitude <> '' AND energy_type = 'wind')"""
GOOD = "status = 'success' AND lon <> '' AND lat <> ''"

QUERIES = {
    "geocode_candidates": (geocode_candidates, _sql("SELECT * FROM cands")),
    "geocode_resolve": (geocode_resolve, _sql(RESOLVED.format(tried="tried"))),
    "geocode_pending": (geocode_pending, _sql("""SELECT query, min(rank) AS rank, arg_min(level, rank) AS level FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS rn FROM tried WHERE NOT cached OR success)
        WHERE rn = 1 AND NOT cached GROUP BY query""")),
    "geocode_enrich_cache": (geocode_enrich_cache, _sql(f"""
        SELECT k.query, k.status, k.lon, a.level AS candidate_level, a.company_name, a.standard_address, a.original_address,
            a.site_name, a.region, CASE WHEN a.query IS NULL THEN k.power_type ELSE '' END AS power_type
        FROM cache k LEFT JOIN (
            SELECT t.query, t.level, {ABOUT}, row_number() OVER (PARTITION BY t.query ORDER BY t.id DESC, t.rank DESC) AS rn
            FROM tried t JOIN structured s USING (id)
            WHERE NOT EXISTS (SELECT 1 FROM tried b WHERE b.id = t.id AND (b.success OR NOT b.cached) AND b.rank < t.rank)) a
        ON a.query = k.query AND a.rn = 1""")),
    "geocode_cascade": (geocode_cascade, _sql(RESOLVED.format(tried="answered"), answered=ANSWERED)),
    "geocode_resume": (geocode_resume, _sql("""SELECT id, 地区, 社会统一信用代码, 企业名称, 标准化地址 FROM (
        SELECT id, 地区, '' AS 社会统一信用代码, 企业名称, 标准化地址,
            row_number() OVER (PARTITION BY 地区, trim(企业名称), 标准化地址 ORDER BY id) AS rn FROM structured)
        WHERE rn = 1 AND NOT contains(企业名称, '某公司')""")),
    "geocode_responses": (geocode_responses, """SELECT CAST(event_id AS VARCHAR) AS query,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'success' ELSE 'failed' END AS status,
        CASE event_type WHEN 'error' THEN 'HTTP 503: busy ' || user_id WHEN 'click' THEN 'ok' WHEN 'view' THEN CASE WHEN user_id = 0 THEN 'missing location' ELSE CAST(user_id AS VARCHAR) END
            WHEN 'purchase' THEN 'OK' ELSE 'missing location' END AS message,
        CASE event_type WHEN 'click' THEN format('{:.15g}', value) WHEN 'purchase' THEN '101.5' END AS lon,
        CASE event_type WHEN 'click' THEN '25.5' WHEN 'purchase' THEN '25.25' END AS lat,
        CASE event_type WHEN 'click' THEN '县' WHEN 'purchase' THEN '' END AS level
        FROM events"""),
    "reverse_poi": (reverse_poi, duck_ctes("points", lookup=LOOKUP) + """
        SELECT original_image AS 原始图片, province_name AS 省, city AS 市, longitude AS 经度, latitude AS 纬度,
            coalesce(l.poi, '') AS POI FROM points LEFT JOIN lookup l ON l.lng = longitude AND l.lat = latitude"""),
    "reverse_pending": (reverse_pending, duck_ctes("points", lookup=LOOKUP) + """
        SELECT DISTINCT longitude AS lng, latitude AS lat FROM points WHERE longitude <> '' AND latitude <> ''
            AND NOT EXISTS (SELECT 1 FROM lookup l WHERE l.lng = longitude AND l.lat = latitude)"""),
    "cache_stats": (cache_stats, _sql(
        f"SELECT count(*) AS total_entries, count(*) FILTER ({GOOD}) AS success_entries FROM cache")),
    "cache_power_types": (cache_power_types, _sql(f"""SELECT coalesce(nullif(power_type, ''), '未标注') AS power_type,
        count(*) AS entries FROM cache WHERE {GOOD} GROUP BY 1""")),
    "cache_bounds": (cache_bounds, _sql(f"""SELECT min(CAST(lon AS DOUBLE)) AS min_lng, min(CAST(lat AS DOUBLE)) AS min_lat,
        max(CAST(lon AS DOUBLE)) AS max_lng, max(CAST(lat AS DOUBLE)) AS max_lat FROM cache
        WHERE {GOOD} AND power_type IN ('风电', '太阳能发电')""")),
    "cache_roundtrip": (cache_roundtrip, _sql("SELECT status, message, lon, lat, level, query FROM cache")),
    "cache_object": (cache_object, _sql("SELECT status, message, lon, lat, level, query FROM cache")),
    "power_types_in_order": (power_types_in_order, _sql(f"""SELECT power_type, entries, row_number() OVER (ORDER BY
            CASE power_type WHEN '风电' THEN 1 WHEN '水电' THEN 2 WHEN '太阳能发电' THEN 3 WHEN '未标注' THEN 4 END) AS place
        FROM (SELECT coalesce(nullif(power_type, ''), '未标注') AS power_type, count(*) AS entries FROM cache WHERE {GOOD} GROUP BY 1)""")),
}

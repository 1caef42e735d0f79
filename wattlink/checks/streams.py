"""Streaming ingest, resumable enrichment and the end-to-end reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlink import constants as K
from wattlink.checks import addresses, association, geocoding, registry
from wattlink.checks.fixtures import duck_ctes, spark_view
from wattlink.operators import geocode as G, views as V
from wattlink.plans import jobs
from wattlink.session import scratch_path, stored
from wattlink.streaming import ingest


def stream_ingest(spark, sf_dir):
    """Pages land as files, are extracted as a stream, and the sink is deduplicated."""
    landing, sink, state = (scratch_path(spark, n) for n in ("pages", "registry", "state"))
    registry.pages(spark, sf_dir).repartition(8).write.json(landing)
    sources = [registry.SOURCE | {"name": name} for name in ("S0", "S1", "S2")]
    ingest.ingest_pages(spark, landing, sink, state, sources, now=registry.NOW, max_files=3).awaitTermination()
    return ingest.read_registry(spark, sink)


def stream_resume(spark, sf_dir):
    """Structured rows land in files, twice; each row key is enriched once."""
    landing, sink, state = (scratch_path(spark, n) for n in ("structured", "geocoded", "state"))
    named = stored(addresses.structured(spark, sf_dir), "structured")  # three readers
    rows = named.select(*K.STRUCTURED_COLUMNS)
    rows.repartition(3).write.parquet(landing)
    rows.repartition(3).write.mode("append").parquet(landing)
    cache = stored(geocoding._cache(spark, sf_dir, named), "cache")  # read by every batch
    query = ingest.resume_enrichment(
        spark, landing, sink, state, lambda batch: G.geocode_resolve(batch, cache), max_files=2)
    query.awaitTermination()
    answered = spark.read.parquet(sink).select(*G.ROW_KEY, "查询地址", "地理编码状态", "经度")
    waiting = ingest.waiting_rows(spark, sink)
    return answered.unionByName(waiting.select(
        *G.ROW_KEY, F.lit(None).alias("查询地址"), F.lit(G.PENDING).alias("地理编码状态"), F.lit(None).alias("经度")))


def preview_counts(spark, sf_dir):
    return _preview(spark, sf_dir).farms.select("id", "enterprise_name", "associated_count")


def preview_documents(spark, sf_dir):
    """Farm documents, all fields read back from their JSON."""
    at = lambda path, kind="string": F.try_variant_get(F.parse_json("json"), path, kind)
    previews = F.transform(at("$.preview_images", "array<variant>"), lambda x: F.concat(
        F.try_variant_get(x, "$.id", "string"), F.lit(" "), F.try_variant_get(x, "$.image_url", "string")))
    return jobs.farm_documents(_preview(spark, sf_dir)).select(
        "farm_id", *[at(f"$.{c}").alias(c) for c in ("enterprise_name", "site_name", "power_type", "capacity", "province")],
        *[at(f"$.{c}", "double").alias(c) for c in ("longitude", "latitude")],
        at("$.associated_count", "long").alias("associated_count"), F.array_join(previews, ",").alias("previews"),
    )


def preview_links(spark, sf_dir):
    """The linked points of the farm documents, all fields read back from their JSON."""
    listed = jobs.link_documents(_preview(spark, sf_dir), 15).select(
        "farm_id", "chunk_no", F.explode(F.try_variant_get(F.parse_json("json"), "$.associated", "array<variant>")).alias("x"))
    at = lambda c, kind="string": F.try_variant_get("x", f"$.{c}", kind).alias(c)
    return listed.select(
        "farm_id", "chunk_no", at("position", "long"), at("recognition_id", "long"), *map(at, POINT_FIELDS), at("image_exists", "long"),
        at("image_url"), at("distance_km", "double"), at("association_source"))


def outlier_images(spark, sf_dir):
    """Points without a link, with the address of their image."""
    return _preview(spark, sf_dir).outliers.select("id", "lng", "lat", *POINT_FIELDS, "image_url")


POINT_FIELDS = ("original_image", "province_name", "city", "longitude", "latitude", "poi")


def _preview(spark, sf_dir):
    farms, points, manual = (spark_view(spark, sf_dir, n) for n in ("farms", "points", "manual"))
    return jobs.association_preview(farms, points, manual, "wind", "radius", 10.0)


def link_bounds(spark, sf_dir):
    """Extent of the linked points of each source of links."""
    _, points, links = association._links(spark, sf_dir, "wind")
    placed = links.join(points.withColumnRenamed("id", "recognition_id"), "recognition_id")
    return V.bounds(placed)


INGESTED = f"""SELECT source AS 地区, CAST(o_orderkey AS VARCHAR) AS 社会统一信用代码, '公司' || o_custkey || '_' || o_orderstatus
        AS 企业名称, CASE WHEN o_orderstatus = 'O' THEN '风电' ELSE '太阳能发电' END AS 发电类型,
        format('{{:.15g}}', CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) / 1000) AS 装机容量, '{registry.NOW}' AS 更新时间
    FROM page_of WHERE {registry.LISTED}"""
URL = "'/api/recognition/image?type=wind&name=' || replace(original_image, ' ', '%20')"
COUNTS = """SELECT f.id, f.enterprise_name, count(l.recognition_id) AS associated_count
    FROM f LEFT JOIN links l ON l.farm_id = f.id GROUP BY f.id, f.enterprise_name"""

QUERIES = {
    "stream_ingest": (stream_ingest, duck_ctes(page_of=registry.PAGE_OF) + INGESTED),
    "stream_resume": (stream_resume, geocoding._sql(
        """SELECT DISTINCT s.地区, '' AS 社会统一信用代码, s.企业名称, s.标准化地址, r.地理编码状态,
               CASE WHEN r.地理编码状态 <> 'pending' THEN r.查询地址 END AS 查询地址, CASE WHEN r.地理编码状态 <> 'pending' THEN r.经度 END AS 经度
           FROM structured s JOIN resolved r USING (id)""", resolved=geocoding.RESOLVED.format(tried="tried"))),
    "preview_counts": (preview_counts, association._sql(COUNTS)),
    "preview_documents": (preview_documents, association._sql(
        f"""SELECT f.id AS farm_id, r.enterprise_name, r.site_name, r.power_type, r.capacity, r.province, f.lng AS longitude,
            f.lat AS latitude, (SELECT count(*) FROM links l WHERE l.farm_id = f.id) AS associated_count,
            coalesce((SELECT string_agg(s.recognition_id || ' ' || s.image_url, ',' ORDER BY s.rn) FROM shown s
                WHERE s.farm_id = f.id AND s.rn <= 8), '') AS previews
           FROM f JOIN farms r ON r.id = f.id""", extra={"shown": f"""SELECT l.farm_id, l.recognition_id, {URL} AS image_url,
            row_number() OVER (PARTITION BY l.farm_id ORDER BY association_source, l.recognition_id DESC) AS rn
            FROM links l JOIN p ON p.id = l.recognition_id WHERE p.image_exists = 1"""})),
    "preview_links": (preview_links, association._sql(f"""SELECT farm_id, (position - 1) // 15 AS chunk_no, position, recognition_id,
            {", ".join(POINT_FIELDS)}, image_exists, CASE WHEN image_exists = 1 THEN {URL} END AS image_url, distance_km, association_source
        FROM (SELECT *, row_number() OVER (PARTITION BY farm_id ORDER BY association_source, recognition_id DESC) AS position FROM links) l
        JOIN points ON points.id = l.recognition_id""")),
    "outlier_images": (outlier_images, association._sql(f"""SELECT p.id, p.lng, p.lat, {", ".join(f"r.{c}" for c in POINT_FIELDS)},
            CASE WHEN p.image_exists = 1 THEN {URL.replace("original_image", "p.original_image")} END AS image_url
        FROM p JOIN points r ON r.id = p.id WHERE p.id NOT IN (SELECT recognition_id FROM links)""")),
    "link_bounds": (link_bounds, association._sql(
        """SELECT min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat
           FROM links JOIN p ON p.id = links.recognition_id""")),
}

"""Queries about links between farms and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlink.checks.fixtures import duck_ctes, spark_view, table
from wattlink.operators import association as A, containment, hull

RADIUS = 10.0


def _frames(spark, sf_dir, energy="wind", province=None):
    farms = A.usable_farms(spark_view(spark, sf_dir, "farms"), energy, province)
    points = A.usable_points(spark_view(spark, sf_dir, "points"), energy, province)
    return farms, points


def _links(spark, sf_dir, energy="wind", mode="radius", manual=True, strategy="auto"):
    farms, points = _frames(spark, sf_dir, energy)
    links = spark_view(spark, sf_dir, "manual") if manual else None
    return farms, points, A.associate(farms, points, links, energy, mode, RADIUS, strategy)


def radius_links(spark, sf_dir):
    return _links(spark, sf_dir, manual=False)[2]


def radius_links_shuffled(spark, sf_dir):
    return _links(spark, sf_dir, manual=False, strategy="shuffle")[2]


def radius_links_province(spark, sf_dir):
    farms, points = _frames(spark, sf_dir, "solar", "云南")
    return A.radius_links(farms, points, 25.0)


def radius_counts(spark, sf_dir):
    farms, _, links = _links(spark, sf_dir, manual=False)
    return A.farm_counts(farms, links).select("id", "enterprise_name", "associated_count")


def radius_summary(spark, sf_dir):
    farms, points, links = _links(spark, sf_dir, "solar", manual=False)
    return A.association_summary(farms, points, links)


def poi_links(spark, sf_dir):
    return _links(spark, sf_dir, "solar", "poi", manual=False)[2]


def links_with_manual(spark, sf_dir):
    return _links(spark, sf_dir)[2]


def manual_only(spark, sf_dir):
    return A.split_links(_links(spark, sf_dir, "solar")[2], "manual")


def manual_with_pending(spark, sf_dir):
    """Manually linked points together with all points still without a link, one row per point."""
    _, points, links = _links(spark, sf_dir)
    mine = A.split_links(links, "manual").select(F.col("recognition_id").alias("id"), F.lit("manual").alias("state"))
    open_ = A.outliers(points, links).select("id", F.lit("open").alias("state"))
    return A.union_by_id(A.union_by_id(mine, open_), mine)


def outliers(spark, sf_dir):
    _, points, links = _links(spark, sf_dir)
    return A.outliers(points, links).select("id", "original_image", "lng", "lat")


def manual_summary(spark, sf_dir):
    farms, points, links = _links(spark, sf_dir)
    return A.association_summary(farms, points, links)


def preview_top8(spark, sf_dir):
    _, points, links = _links(spark, sf_dir, "solar")
    return A.preview_images(links, A.with_image_url(points, spark_view(spark, sf_dir, "images")))


def farm_link_lists(spark, sf_dir):
    _, _, links = _links(spark, sf_dir)
    lists = A.farm_link_lists(links)
    text = F.array_join(
        F.transform("links", lambda x: F.concat(F.substring(x["association_source"], 1, 1), x["recognition_id"].cast("string"))),
        ",",
    )
    return lists.select("farm_id", "chunk_no", text.alias("linked"))


def farm_hull(spark, sf_dir):
    farms, points, links = _links(spark, sf_dir)
    return hull.hull_vertices(hull.farm_hulls(farms, links, points))


def names_in_documents(spark, sf_dir):
    """Which documents name which places: the first two words of every benchmark text, inside whole texts."""
    names = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", PLACE, 0).alias("place")).where("place <> ''").distinct()
    texts = table(spark, sf_dir, "documents").select("text").where("text IS NOT NULL").distinct()
    found = containment.containing_pairs(names, texts, "place", "text")
    return found.groupBy("place").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("characters"))


PLACE = "^[^ ]+ [^ ]+"


def _usable(energy, province=None):
    types = "('风电')" if energy == "wind" else "('太阳能发电', '分布式光伏')"
    f = f"""SELECT id, enterprise_name, raw_address, TRY_CAST(longitude AS DOUBLE) AS lng, TRY_CAST(latitude AS DOUBLE) AS lat
        FROM farms WHERE power_type IN {types} AND longitude <> '' AND latitude <> ''"""
    p = f"""SELECT id, original_image, energy_type, image_exists, poi, TRY_CAST(longitude AS DOUBLE) AS lng,
        TRY_CAST(latitude AS DOUBLE) AS lat FROM points WHERE energy_type = '{energy}' AND longitude <> '' AND latitude <> ''"""
    if province:
        f += f" AND contains(province, '{province}')"
        p += f" AND (contains(province_name, '{province}') OR contains(province_code, '{province}'))"
    return {"f": f, "p": p}


KM = """2 * 6371 * asin(sqrt(pow(sin(radians(f.lat - p.lat) / 2), 2)
    + cos(radians(p.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lng - p.lng) / 2), 2)))"""
SQUASH = r"regexp_replace(regexp_replace({0}, '\s', '', 'g'), '[()（）_\-—,，。.、]', '', 'g')"


def _auto(condition):
    return f"""SELECT farm_id, recognition_id, round(km, 3) AS distance_km, 'auto' AS association_source FROM (
        SELECT f.id AS farm_id, p.id AS recognition_id, {KM} AS km,
               row_number() OVER (PARTITION BY p.id ORDER BY {KM}, f.enterprise_name) AS rn
        FROM p JOIN f ON {condition}) WHERE rn = 1"""


def _within(radius):
    # the first test only spares the exact one far-away pairs: a degree of latitude is over 111 km
    return f"abs(f.lat - p.lat) <= {radius} / 111.0 AND {KM} <= {radius}"


TEXT_MATCH = """length(f.t) >= 2 AND length(p.t) >= 2 AND (contains(p.t, f.t) OR contains(f.t, p.t))"""


def _sql(select, energy="wind", manual=True, radius=RADIUS, province=None, extra=None, condition=None, views=()):
    more = _usable(energy, province)
    more["auto"] = _auto(condition or _within(radius))
    if manual:
        more["links"] = f"""SELECT * FROM auto UNION ALL
            SELECT f.id, p.id, round({KM}, 3), 'manual' FROM manual m JOIN f ON f.id = m.farm_id
            JOIN p ON p.id = m.recognition_id
            WHERE m.energy_type = '{energy}' AND NOT EXISTS (SELECT 1 FROM auto a
                WHERE a.farm_id = m.farm_id AND a.recognition_id = m.recognition_id)"""
    else:
        more["links"] = "SELECT * FROM auto"
    more.update(extra or {})
    return duck_ctes("farms", "points", "manual", *views, **more) + "\n" + select


SUMMARY = """SELECT (SELECT count(*) FROM f) AS farm_count,
    (SELECT count(DISTINCT farm_id) FROM links) AS linked_farm_count, (SELECT count(*) FROM p) AS recognition_count,
    (SELECT count(DISTINCT recognition_id) FROM links) AS linked_recognition_count,
    (SELECT count(*) FROM p WHERE id NOT IN (SELECT recognition_id FROM links)) AS outlier_count"""

POI_SQL = (
    duck_ctes("farms", "points", **{k + "_raw": v for k, v in _usable("solar").items()}, **{
        "f": f"SELECT *, {SQUASH.format('raw_address')} AS t FROM f_raw",
        "p": f"SELECT *, {SQUASH.format('poi')} AS t FROM p_raw",
        # pairs of distinct texts first: the test of two texts is the same for all their rows
        "tp": f"""SELECT f.t AS ft, p.t AS pt FROM (SELECT DISTINCT t FROM f) f JOIN (SELECT DISTINCT t FROM p) p
                  ON {TEXT_MATCH}""",
    })
    + f"""
    SELECT farm_id, recognition_id, round(km, 3) AS distance_km, 'auto' AS association_source FROM (
        SELECT f.id AS farm_id, p.id AS recognition_id, {KM} AS km,
               row_number() OVER (PARTITION BY p.id ORDER BY {KM}, f.enterprise_name) AS rn
        FROM p JOIN tp ON tp.pt = p.t JOIN f ON f.t = tp.ft) WHERE rn = 1"""
)

# a point is a hull vertex if some other point can be reached from it with everything on the left
HULL_EXTRA = {
    "seeds": """SELECT DISTINCT farm_id, lng, lat FROM (
        SELECT id AS farm_id, lng, lat FROM f UNION ALL
        SELECT l.farm_id, p.lng, p.lat FROM links l JOIN p ON p.id = l.recognition_id)""",
    "sizes": """SELECT f.id AS farm_id, 1 + count(l.recognition_id) AS n FROM f LEFT JOIN links l ON l.farm_id = f.id
        GROUP BY f.id""",
    "edges": """SELECT a.farm_id, a.lng AS ax, a.lat AS ay, b.lng AS bx, b.lat AS by_,
            min((b.lng - a.lng) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lng - a.lng)) AS worst,
            max(CASE WHEN (b.lng - a.lng) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lng - a.lng) = 0
                THEN pow(c.lng - a.lng, 2) + pow(c.lat - a.lat, 2) END)
            - (pow(b.lng - a.lng, 2) + pow(b.lat - a.lat, 2)) AS beyond
        FROM seeds a JOIN seeds b ON a.farm_id = b.farm_id AND (a.lng <> b.lng OR a.lat <> b.lat)
        JOIN seeds c ON c.farm_id = a.farm_id
        GROUP BY a.farm_id, a.lng, a.lat, b.lng, b.lat""",
    "turning": """SELECT farm_id, ax AS lng, ay AS lat, bx, by_ FROM edges WHERE worst >= 0 AND beyond <= 0""",
    "ends": """SELECT farm_id, min(struct_pack(lng := lng, lat := lat)) AS lo, max(struct_pack(lng := lng, lat := lat)) AS hi
        FROM turning GROUP BY farm_id""",
    "placed": """SELECT t.farm_id, t.lng, t.lat,
            (hi.lng - lo.lng) * (t.lat - lo.lat) - (hi.lat - lo.lat) * (t.lng - lo.lng) > 0
            OR (t.lng = hi.lng AND t.lat = hi.lat) AS upper
        FROM (SELECT DISTINCT farm_id, lng, lat FROM turning) t JOIN ends USING (farm_id)""",
    "big": """SELECT farm_id, row_number() OVER (PARTITION BY farm_id ORDER BY upper,
            CASE WHEN upper THEN -lng ELSE lng END, CASE WHEN upper THEN -lat ELSE lat END) - 1 AS vertex_no, lng, lat
        FROM placed JOIN sizes USING (farm_id) WHERE n > 2""",
    "small": """SELECT farm_id, row_number() OVER (PARTITION BY farm_id ORDER BY k) - 1 AS vertex_no, lng, lat FROM (
            SELECT id AS farm_id, 0 AS k, lng, lat FROM f UNION ALL
            SELECT l.farm_id, 1, p.lng, p.lat FROM links l JOIN p ON p.id = l.recognition_id)
        JOIN sizes USING (farm_id) WHERE n <= 2""",
}

QUERIES = {
    "names_in_documents": (names_in_documents, f"""WITH places AS (SELECT DISTINCT regexp_extract(text, '{PLACE}') AS place FROM benchmark),
        texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
        SELECT place, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters
        FROM places JOIN texts ON contains(text, place) WHERE place <> '' GROUP BY place"""),
    "assoc_radius_links": (radius_links, _sql("SELECT * FROM links", manual=False)),
    "assoc_radius_links_shuffled": (radius_links_shuffled, _sql("SELECT * FROM links", manual=False)),
    "assoc_radius_links_province": (
        radius_links_province, _sql("SELECT * FROM links", "solar", False, 25.0, "云南")),
    "assoc_radius_counts": (radius_counts, _sql(
        """SELECT f.id, f.enterprise_name, count(l.recognition_id) AS associated_count
           FROM f LEFT JOIN links l ON l.farm_id = f.id GROUP BY f.id, f.enterprise_name""", manual=False)),
    "assoc_radius_summary": (radius_summary, _sql(SUMMARY, "solar", False)),
    "assoc_poi_links": (poi_links, POI_SQL),
    "assoc_with_manual": (links_with_manual, _sql("SELECT * FROM links")),
    "assoc_manual_only": (manual_only, _sql("SELECT * FROM links WHERE association_source = 'manual'", "solar")),
    "assoc_manual_with_pending": (manual_with_pending, _sql(
        """SELECT DISTINCT recognition_id AS id, 'manual' AS state FROM links WHERE association_source = 'manual' UNION ALL
           SELECT id, 'open' FROM p WHERE id NOT IN (SELECT recognition_id FROM links)""")),
    "assoc_outliers": (outliers, _sql(
        "SELECT id, original_image, lng, lat FROM p WHERE id NOT IN (SELECT recognition_id FROM links)")),
    "assoc_manual_summary": (manual_summary, _sql(SUMMARY)),
    "preview_top8": (preview_top8, _sql(
        """SELECT farm_id, rn AS position, recognition_id, original_image, image_url FROM (
            SELECT l.farm_id, l.recognition_id, p.original_image,
                '/api/recognition/image?type=solar&name=' || replace(p.original_image, ' ', '%20') AS image_url,
                row_number() OVER (PARTITION BY l.farm_id ORDER BY association_source, l.recognition_id DESC) AS rn
            FROM links l JOIN p ON p.id = l.recognition_id
            WHERE p.image_exists = 1 AND p.original_image IN (SELECT name FROM images)) WHERE rn <= 8""",
        "solar", views=("images",))),
    "farm_link_lists": (farm_link_lists, _sql(
        """SELECT farm_id, 0 AS chunk_no, string_agg(substr(association_source, 1, 1) || CAST(recognition_id AS VARCHAR), ','
           ORDER BY association_source, recognition_id DESC) AS linked FROM links GROUP BY farm_id""")),
    "farm_hull": (farm_hull, _sql("SELECT * FROM big UNION ALL SELECT * FROM small", extra=HULL_EXTRA)),
}

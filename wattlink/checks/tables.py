"""Queries about imports, upserts, deletes, searches, exports and geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wattlink import constants as K, schemas
from wattlink.checks.fixtures import duck_ctes, spark_view, table
from wattlink.functions import geo, measure as M
from wattlink.operators import association as A, imports as I, polygons as P, registry as R, views as V
from wattlink.operators.pages import ordered_pages
from wattlink.operators.postings import build_index
from wattlink.operators.ranking import in_read_order, numbered
from wattlink.plans import jobs
from wattlink.session import scratch_path, ship
from wattlink.sources import csvio, images, tables as T

OLD, NOW = "2025-01-01 00:00:00", "2026-01-01 00:00:00"

# ten observations per site on average; a third of them under new names
INCOMING = """
SELECT o_orderkey + 1 AS row_no, CASE o_orderstatus WHEN 'F' THEN CONCAT('新站', CAST(o_custkey AS STRING))
        ELSE CONCAT('Customer#', LPAD(CAST(o_custkey AS STRING), 9, '0')) END AS name,
    o_orderpriority AS kind, CAST(o_orderkey AS STRING) AS cap,
    CASE WHEN o_totalprice > 250000 THEN ' 0.93 ' WHEN o_totalprice > 100000 THEN 'bad' ELSE '' END AS conf
FROM @orders@
"""


def _farms(spark, sf_dir):
    farms = spark_view(spark, sf_dir, "farms")
    return T.conform(farms.withColumns({"created_at": F.lit(OLD), "updated_at": F.lit(OLD)}), schemas.POWER_FIELDS)


def _points(spark, sf_dir):
    points = spark_view(spark, sf_dir, "points")
    return T.conform(points.withColumns({"created_at": F.lit(OLD), "updated_at": F.lit(OLD)}), schemas.RECOGNITION)


def _manual(spark, sf_dir):
    manual = spark_view(spark, sf_dir, "manual").withColumn("id", F.col("recognition_id") * 2)
    return T.conform(manual.withColumns({"created_at": F.lit(OLD), "updated_at": F.lit(OLD)}), schemas.MANUAL_ASSOCIATIONS)


def _import_file(spark, sf_dir):
    """The incoming rows with the columns of an import file."""
    rows = spark_view(spark, sf_dir, INCOMING)
    filled = {"企业名称": "name", "发电类型": "kind", "装机容量": "cap", "经纬度可信度": "conf"}
    return rows.select("row_no", *[
        (F.col(filled[c]) if c in filled else F.lit("")).alias(c) for c in K.FARM_IMPORT_COLUMNS
    ])


FARM_STATE = ["id", "enterprise_name", "power_type", "capacity", "raw_address", "confidence", "created_at", "updated_at"]


def upsert_farms(spark, sf_dir):
    return I.import_farms(_farms(spark, sf_dir), _import_file(spark, sf_dir), NOW).select(*FARM_STATE)


def snapshot_import(spark, sf_dir):
    """The same import through stored snapshots: write, merge, read back."""
    root = scratch_path(spark, "tables")
    T.write_table(_farms(spark, sf_dir).drop("capacity"), root, "power_fields")
    jobs.import_file(spark, root, _import_file(spark, sf_dir), "power-fields", NOW)
    return T.read_table(spark, root, "power_fields").select(*FARM_STATE)


def upsert_by_key(spark, sf_dir):
    """The same import into a table kept by key: only folders of the file's keys are rewritten."""
    root = scratch_path(spark, "tables")
    T.write_by_key(_farms(spark, sf_dir), root, "power_fields")
    rows = I.farm_rows(I.validate_import(_import_file(spark, sf_dir), "power-fields"))
    T.upsert_by_key(spark, root, "power_fields", rows, NOW)
    return T.read_by_key(spark, root, "power_fields").select(*FARM_STATE)


def upsert_points(spark, sf_dir):
    points = _points(spark, sf_dir)
    rows = spark_view(spark, sf_dir, """SELECT l_orderkey * 10 + l_linenumber AS row_no,
        CASE WHEN l_returnflag = 'N' THEN CONCAT(' tile ', CAST(l_orderkey + 1 AS STRING), '.jpg ')
            ELSE CONCAT('part ', CAST(l_partkey AS STRING), '.jpg') END AS original_image,
        CAST(l_quantity AS STRING) AS turbine_lon, '25.5' AS turbine_lat, 'YunNan' AS province,
        l_shipdate_text AS city, '' AS `省` FROM (SELECT *, CAST(l_suppkey AS STRING) AS l_shipdate_text FROM @lineitem@)""")
    # a line number can repeat within an order: number the rows
    rows = numbered(rows.drop("row_no"), [F.col(c) for c in ("original_image", "city", "turbine_lon")])
    state = I.import_points(points, rows, "wind", spark_view(spark, sf_dir, "images"), NOW)
    return state.select("id", "energy_type", "original_image", "province_code", "province_name", "city", "longitude",
                        "latitude", "poi", "image_exists", "created_at", "updated_at")


def _wanted_links(spark, sf_dir):
    return spark_view(spark, sf_dir, """SELECT o_orderkey AS row_no,
        CASE WHEN o_orderstatus = 'O' THEN 'wind' ELSE 'solar' END AS energy_type,
        o_custkey + 1 AS farm_id, CASE WHEN o_orderpriority = '5-LOW' THEN -o_orderkey ELSE o_orderkey + 1 END AS recognition_id
        FROM @orders@""")


def upsert_manual(spark, sf_dir):
    return I.add_manual_links(_manual(spark, sf_dir), _wanted_links(spark, sf_dir), _farms(spark, sf_dir), _points(spark, sf_dir), NOW)


def delete_filtered(spark, sf_dir):
    return I.delete_where(_farms(spark, sf_dir), V.farm_condition("云南 #0", None, "low")).select("id", "enterprise_name")


def delete_all(spark, sf_dir):
    """A delete without a condition, through snapshots written and read back."""
    root = scratch_path(spark, "tables")
    T.write_table(_farms(spark, sf_dir), root, "power_fields")
    before = T.read_table(spark, root, "power_fields")
    T.write_table(I.delete_where(before, V.farm_condition()), root, "power_fields")
    left = T.read_table(spark, root, "power_fields")
    states = [df.select(F.lit(state).alias("state")) for state, df in (("before", before), ("left", left))]
    return states[0].unionByName(states[1]).agg(*[F.count_if(F.col("state") == s).alias(f"rows_{s}") for s in ("before", "left")])


def delete_unlinked(spark, sf_dir):
    return I.delete_points_without_image(
        _points(spark, sf_dir), spark_view(spark, sf_dir, "images"), V.province_like("zhe")
    ).select("id", "original_image")


def delete_manual(spark, sf_dir):
    """By the full key; some of the wanted links name another farm and delete nothing."""
    gone = _wanted_links(spark, sf_dir).withColumn("farm_id", F.col("farm_id") + F.col("recognition_id") % 2)
    return I.delete_keys(_manual(spark, sf_dir), gone, ["energy_type", "farm_id", "recognition_id"]).select(
        "id", "energy_type", "farm_id", "recognition_id")


def validate_rows(spark, sf_dir):
    rows = _points(spark, sf_dir).select(
        "id", F.col("original_image").alias("Tile_Name"), F.col("longitude").alias("Longitude"),
        F.col("latitude").alias("Latitude"), F.lit("").alias("Empty_Column"), F.col("province_code").alias("Province"),
        F.when(F.col("image_exists") == 1, F.col("city")).otherwise("  ").alias("City_County"))
    return I.with_first_problem(rows, "solar-recognition").where("missing_field IS NOT NULL").select("id", "missing_field")


def import_header_check(spark, sf_dir):
    """What recognition files are refused with: the same rows with the first bad row in its place, and ahead of all."""
    points = _points(spark, sf_dir)
    cells = {"原始图片": "original_image", "经度": "longitude", "纬度": "latitude", "省": "province_code", "市": "city", "POI": "poi"}
    files = {
        "in place": points.select(F.when(F.col("longitude") == "", F.col("id")).otherwise(F.col("id") - (1 << 40)).alias("row_no"),
                                  *[F.col(c).alias(n) for n, c in cells.items()]),
        "ahead": points.select(F.when(F.col("longitude") == "", F.col("id") - (1 << 40)).otherwise(F.col("id")).alias("row_no"),
                               *[F.col(c).alias(n) for n, c in cells.items()]),
    }
    found = []
    for name, rows in files.items():
        try:
            I.validate_import(rows, "solar-recognition")
            found.append((name, None))
        except I.ImportRejected as e:
            found.append((name, str(e)))
    return spark.createDataFrame(found, "file string, message string")


def export_file(spark, sf_dir):
    """The lines of the export file; those of its first part are the header. The reader takes the byte order mark off."""
    path = scratch_path(spark, "export")
    view = _points(spark, sf_dir).withColumn("poi", F.concat("poi", F.lit(',"'), "city"))
    csvio.write_export(csvio.recognition_export(view), path)
    return spark.read.text(path).select(
        (F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int") == 0).alias("opening"), F.col("value").alias("line"))


def boundary_bounds(spark, sf_dir):
    """Extent of all rings of each group of five documents."""
    rings = _polygons(spark, sf_dir).withColumn("boundary_id", F.col("polygon_id") % 5)
    return P.boundary_bounds(rings, ["boundary_id"])


def unlocated_rows(spark, sf_dir):
    """Farms and points that no link can reach."""
    return A.unlocated(spark_view(spark, sf_dir, "farms"), spark_view(spark, sf_dir, "points"), "other", "浙江").select("kind", "id")


def row_numbers(spark, sf_dir):
    """Consecutive numbers over a whole table and within groups."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return numbered(numbered(orders, order), order, ["o_orderstatus"], "place")


def read_order_numbers(spark, sf_dir):
    """Rows that are read in a known order keep it in their numbers."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return in_read_order(rows.orderBy(F.desc("o_totalprice"), "o_orderkey"))


def search_farms(spark, sf_dir):
    return V.search_farms(_farms(spark, sf_dir), "CUSTOMER 云_", "发电", "medium").select("id", "enterprise_name", "confidence")


SEARCHES = [("indexed", "CUSTOMER 云_", "发电", "medium"), ("rare", "mer#000000012", None, None), ("both", "0001 浙江省", None, "low"),
            ("short", "江", "风电", None), ("wild", "cust%99", None, None), ("absent", "不存在的", None, None)]


def search_postings(spark, sf_dir):
    """Searches over stored trigram postings, and the one that has to scan."""
    index = build_index(_farms(spark, sf_dir))
    found = [index.search(spark, *asked).select(F.lit(name).alias("search"), "id", "enterprise_name") for name, *asked in SEARCHES]
    return reduce(DataFrame.unionByName, found)


def confidence_bands(spark, sf_dir):
    farms = spark_view(spark, sf_dir, "farms")
    return farms.groupBy(V.confidence_band().alias("band"), M.confidence_label("confidence").alias("label")).agg(
        F.count("*").alias("farms"))


def recognition_view(spark, sf_dir):
    view = V.recognition_view(_points(spark, sf_dir), spark_view(spark, sf_dir, "images"), "YUN")
    return view.select("id", "original_image", "image_url")


def recognition_unlinked(spark, sf_dir):
    view = V.recognition_view(_points(spark, sf_dir), spark_view(spark, sf_dir, "images"), unlinked_only=True)
    return view.select("id", "image_url")


def recognition_page(spark, sf_dir):
    view = V.recognition_view(_points(spark, sf_dir), spark_view(spark, sf_dir, "images"), unlinked_only=True)
    return V.page(view, 3, 10).select("id", "original_image")


def recognition_deep_page(spark, sf_dir):
    """The page of ten in the middle of all points."""
    pages = ordered_pages(_points(spark, sf_dir))
    return pages.page(spark, pages.total // 20 + 1, 10).select("id", "original_image")


def recognition_total(spark, sf_dir):
    return V.total(V.recognition_view(_points(spark, sf_dir), spark_view(spark, sf_dir, "images"), unlinked_only=True))


def farms_page_after(spark, sf_dir):
    return V.page_after(_farms(spark, sf_dir), 100, 20).select("id", "enterprise_name")


def farms_of_unlisted_province(spark, sf_dir):
    """A province that is not on the list keeps LIKE rules."""
    farms = spark_view(spark, sf_dir, "farms")
    return farms.where(V.province_match("province", "_南")).select("id", "province")


def strict_import_file(spark, sf_dir):
    """A strict import file with line breaks, quotes and blanks in its cells: rows in file order."""
    path = scratch_path(spark, "import")
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey").select(
        F.concat(F.lit("  "), "c_name", F.lit('\n"站" ')).alias("企业名称"), F.col("c_custkey").cast("string").alias("装机容量"), F.lit(" ").alias("省"))
    csvio.write_csv(rows, path)
    return csvio.read_import_csv(spark, path)


def _image_paths(spark, sf_dir):
    """Paths of made-up images below a folder per nation: some hidden, some under a second name."""
    return table(spark, sf_dir, "customer").select(F.concat(
        F.when(F.col("c_custkey") % 11 == 0, ".trash/").otherwise("tiles/"), F.col("c_nationkey").cast("string"),
        F.when(F.col("c_custkey") % 3 == 0, "/sub/").otherwise("/"),
        F.when(F.col("c_custkey") % 5 == 0, "_").when(F.col("c_custkey") % 7 == 0, ".").otherwise(""),
        (F.col("c_custkey") % 400).cast("string"), F.lit(" +%.jpg")).alias("path"))


def _written(root):
    """Make the files of a column of paths below `root`, empty or not."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                system, inside, _ = images.opened(f"{root}/{path}")
                system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inside) as out:
                    out.write(b"" if len(path) % 2 else b"1")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["path"])

    return run


def image_inventory(spark, sf_dir):
    """Every file below a written tree, and of each name the greatest path."""
    root = scratch_path(spark, "tree")
    ship(spark)
    _image_paths(spark, sf_dir).distinct().mapInArrow(_written(root), "path string").count()
    files = images.list_images(spark, root)
    best = images.image_names(files).select("name", F.col("path").alias("best"))
    below = lambda c: F.regexp_replace(c, "^.*?/(?=tiles/)", "").alias(c)
    return files.join(best, "name").select("name", below("path"), below("best"))


def landed_inventory(spark, sf_dir):
    """The same from a table of paths."""
    files = images.landed_images(_image_paths(spark, sf_dir))
    return files.join(images.image_names(files).select("name", F.col("path").alias("best")), "name").select("name", "path", "best")


def import_template_rows(spark, sf_dir):
    """The sample row of the farm template under the name of every customer, taken through the import."""
    template = csvio.import_template(spark, "power-fields")
    sample = template.first().asDict()
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"), *[
        (F.col("c_name") if c == "企业名称" else F.lit(sample[c])).alias(c) for c in template.columns])
    return I.farm_rows(I.validate_import(rows, "power-fields")).select(
        "row_no", "enterprise_name", "power_type", "capacity", "longitude", "latitude", "confidence")


def current_stamps(spark, sf_dir):
    """Rows stamped with the time of the run, held against the clock."""
    stamped = table(spark, sf_dir, "orders").select("o_orderkey", R.update_stamp().alias("stamp"), F.current_timestamp().alias("now"))
    age = F.unix_timestamp("now") - F.unix_timestamp(R.parsed_time("stamp"))
    return stamped.select("o_orderkey", F.length("stamp").cast("long").alias("size"), age.between(0, 1).alias("is_now"))


def farms_of_province(spark, sf_dir):
    farms = spark_view(spark, sf_dir, "farms")
    return farms.where(V.energy_match("solar") & V.province_match("province", "浙江")).select("id", "province")


def import_image_flags(spark, sf_dir):
    rows = _points(spark, sf_dir).select(F.col("id").alias("row_no"), F.col("original_image").alias("原始图片"),
                                         F.col("longitude").alias("经度"), F.col("latitude").alias("纬度"),
                                         F.col("province_code").alias("省"), F.col("city").alias("市"))
    return I.recognition_rows(rows, "solar", spark_view(spark, sf_dir, "images")).select(
        F.col("row_no").alias("id"), "image_exists", "province_name")


def image_urls(spark, sf_dir):
    points = A.with_image_url(_points(spark, sf_dir), spark_view(spark, sf_dir, "images"))
    return points.select("id", "image_url")


def export_lines(spark, sf_dir):
    view = _points(spark, sf_dir).withColumn("poi", F.concat("poi", F.lit(',"'), "city"))
    return csvio.csv_lines(csvio.recognition_export(view))


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    view = _points(spark, sf_dir).withColumn("poi", F.concat("poi", F.lit('"\n,'), "city"))
    csvio.write_csv(csvio.recognition_export(view), path)
    return csvio.read_text_csv(spark, path).select(*[F.coalesce(c, F.lit("")).alias(c) for c in K.POI_OUTPUT_COLUMNS])


def registry_csv(spark, sf_dir):
    path = scratch_path(spark, "registry")
    rows = spark_view(spark, sf_dir, """SELECT CAST(c_custkey AS STRING) AS `地区`, c_mktsegment AS `社会统一信用代码`,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'NA' WHEN 'MACHINERY' THEN 'null' ELSE c_name END AS `企业名称` FROM @customer@""")
    csvio.write_csv(rows, path)
    csvio.append_csv(spark, path, rows, rows.columns)
    return csvio.read_registry_csv(spark, path)


def finite_coordinates(spark, sf_dir):
    """All readings of coordinate text, blank as missing and blank as zero."""
    points = spark_view(spark, sf_dir, """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN CONCAT(' ',
        CAST(o_orderkey AS STRING), '. ') WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN CONCAT(CAST(o_orderkey AS STRING), 'd')
        WHEN '5-LOW' THEN 'Infinity' ELSE CONCAT('-.', CAST(o_orderkey AS STRING), 'E1') END AS t FROM @orders@""")
    return points.select("id", M.finite_number("t").alias("number"), M.finite_number("t", True).alias("blank_zero"))


def distances(spark, sf_dir):
    p = spark_view(spark, sf_dir, "points").select(
        "id", M.finite_number("longitude").alias("lng"), M.finite_number("latitude").alias("lat"))
    km = geo.haversine_km(F.lit(25.0), F.lit(102.8), F.col("lat"), F.col("lng"))
    return p.select("id", F.round(km, 3).alias("km"))


# --- polygons: one star per nation and orders in them ----------------------------------------

# corner k of nation n; every second corner is drawn in, which makes the ring concave
_R = "CASE WHEN k % 2 = 0 THEN 1.5e0 ELSE 0.6e0 END"
_CORNER = "n_nationkey, explode(sequence(0, 9)) AS k"
RING = f"""SELECT n_nationkey AS polygon_id, k,
    98e0 + CAST((n_nationkey * 7919) % 8000 AS DOUBLE) / 1e3 + floor(1e3 * {_R} * cos(k * 0.6283e0 + n_nationkey)) / 1e3 AS lng,
    22e0 + CAST((n_nationkey * 1299) % 7000 AS DOUBLE) / 1e3 + floor(1e3 * {_R} * sin(k * 0.6283e0 + n_nationkey)) / 1e3 AS lat
FROM (SELECT {_CORNER} FROM @nation@) corners"""


def _geojson(spark, sf_dir):
    """One document per region: even nations as Polygon with a hole, odd ones as MultiPolygon."""
    ring = spark_view(spark, sf_dir, RING).groupBy("polygon_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "lng", "lat"))), lambda p: F.array(p["lng"], p["lat"])).alias("ring"))
    hole = F.array(F.array(F.array(F.lit(0.0), F.lit(0.0))))
    odd = F.col("polygon_id") % 2 == 1
    geometry = F.when(odd, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array("ring")).alias("coordinates"))))
    geometry = geometry.otherwise(F.to_json(F.struct(
        F.lit("Polygon").alias("type"), F.concat(F.array("ring"), hole).alias("coordinates"))))
    return ring.select("polygon_id", F.concat(F.lit('{"features":[{"geometry":'), geometry, F.lit("}]}")).alias("body"))


def _polygons(spark, sf_dir):
    return P.outer_rings(_geojson(spark, sf_dir), keep=["polygon_id"])


def ring_bounds(spark, sf_dir):
    rings = _polygons(spark, sf_dir)
    return rings.select("polygon_id", F.size("ring").alias("corners"), P.ring_bounds().alias("b")).select(
        "polygon_id", "corners", "b.*")


def point_in_polygon(spark, sf_dir):
    points = A.usable_points(_points(spark, sf_dir), "solar")
    return P.points_in_polygons(points, _polygons(spark, sf_dir))


# --- the same rules in SQL ---------------------------------------------------------------------

FARM_SQL = duck_ctes("farms", incoming=INCOMING) + f""",
    last AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY name ORDER BY row_no DESC) = 1),
    opening AS (SELECT name, min(row_no) AS r FROM incoming GROUP BY name)
    SELECT coalesce(f.id, (SELECT max(id) FROM farms) + row_number() OVER (PARTITION BY f.id IS NULL ORDER BY o.r)) AS id,
        coalesce(f.enterprise_name, l.name) AS enterprise_name, CASE WHEN l.name IS NULL THEN f.power_type ELSE l.kind END AS power_type,
        CASE WHEN l.name IS NULL THEN f.capacity ELSE l.cap END AS capacity,
        CASE WHEN l.name IS NULL THEN f.raw_address ELSE '' END AS raw_address,
        CASE WHEN l.name IS NULL THEN f.confidence ELSE coalesce(TRY_CAST(trim(l.conf) AS DOUBLE), 0) END AS confidence,
        CASE WHEN f.id IS NULL THEN '{NOW}' ELSE '{OLD}' END AS created_at,
        CASE WHEN l.name IS NULL THEN '{OLD}' ELSE '{NOW}' END AS updated_at
    FROM farms f FULL JOIN last l ON l.name = f.enterprise_name LEFT JOIN opening o ON o.name = l.name"""
RING_DUCK = RING.replace("explode(sequence(0, 9))", "unnest(generate_series(0, 9))")
HITS = """SELECT p.id, e.polygon_id FROM (SELECT id, CAST(longitude AS DOUBLE) AS lng, CAST(latitude AS DOUBLE) AS lat FROM points
        WHERE energy_type = 'solar' AND longitude <> '' AND latitude <> '') p
    JOIN edges e ON (e.lat > p.lat) <> (e.lat2 > p.lat) AND p.lng < (e.lng2 - e.lng) * (p.lat - e.lat) / (e.lat2 - e.lat) + e.lng
    GROUP BY p.id, e.polygon_id HAVING count(*) % 2 = 1"""
UNLINKED = "original_image NOT IN (SELECT name FROM images)"
URL = "'/api/recognition/image?type=' || energy_type || '&name=' || replace(original_image, ' ', '%20')"

TREE = """SELECT DISTINCT n || '.jpg' AS name, 'tiles/' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '/sub/' ELSE '/' END || n || '.jpg' AS path
    FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN '_' ELSE '' END || (c_custkey % 400) || ' +%' AS n FROM customer)
    WHERE c_custkey % 11 <> 0 AND (c_custkey % 7 <> 0 OR c_custkey % 5 = 0)"""
INVENTORY_SQL = f"SELECT name, path, max(path) OVER (PARTITION BY name) AS best FROM ({TREE})"

QUERIES = {
    "image_inventory": (image_inventory, INVENTORY_SQL),
    "landed_inventory": (landed_inventory, INVENTORY_SQL),
    "upsert_farms": (upsert_farms, FARM_SQL),
    "upsert_by_key": (upsert_by_key, FARM_SQL),
    "farms_of_unlisted_province": (farms_of_unlisted_province, duck_ctes("farms") + "SELECT id, province FROM farms WHERE province LIKE '%_南%'"),
    "strict_import_file": (strict_import_file, """SELECT c_name || chr(10) || '"站"' AS 企业名称, CAST(c_custkey AS VARCHAR) AS 装机容量, '' AS 省,
        row_number() OVER (ORDER BY c_custkey) AS row_no FROM customer"""),
    "import_template_rows": (import_template_rows, """SELECT c_custkey AS row_no, c_name AS enterprise_name, '太阳能发电' AS power_type,
        '2' AS capacity, '99.214841' AS longitude, '26.077895' AS latitude, 0.95::DOUBLE AS confidence FROM customer"""),
    "current_stamps": (current_stamps, "SELECT o_orderkey, 19::BIGINT AS size, true AS is_now FROM orders"),
    "snapshot_import": (snapshot_import, FARM_SQL.replace("f.capacity ELSE", "NULL ELSE")),
    "upsert_points": (upsert_points, duck_ctes("points", "images") + f""",
        incoming AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'tile ' || (l_orderkey + 1) || '.jpg' ELSE 'part ' || l_partkey || '.jpg' END
                AS original_image, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE '' END AS lead, CAST(l_suppkey AS VARCHAR) AS city,
            CAST(l_quantity AS VARCHAR) AS longitude FROM lineitem),
        last AS (SELECT original_image, max(struct_pack(c := city, q := longitude)) AS v, min(lead || original_image || lead) AS raw
            FROM incoming GROUP BY original_image)
        SELECT coalesce(p.id, (SELECT max(id) FROM points) + row_number() OVER (PARTITION BY p.id IS NULL ORDER BY l.raw)) AS id,
            coalesce(p.energy_type, 'wind') AS energy_type, coalesce(p.original_image, l.original_image) AS original_image,
            CASE WHEN l.v IS NULL THEN p.latitude ELSE '25.5' END AS latitude, CASE WHEN l.v IS NULL THEN p.poi ELSE '' END AS poi,
            CASE WHEN p.id IS NULL THEN '{NOW}' ELSE '{OLD}' END AS created_at,
            CASE WHEN l.v IS NULL THEN p.province_code ELSE 'YunNan' END AS province_code,
            CASE WHEN l.v IS NULL THEN p.province_name ELSE '云南省' END AS province_name,
            CASE WHEN l.v IS NULL THEN p.city ELSE l.v.c END AS city, CASE WHEN l.v IS NULL THEN p.longitude ELSE l.v.q END AS longitude,
            CASE WHEN l.v IS NULL THEN p.image_exists WHEN l.original_image IN (SELECT name FROM images) THEN 1 ELSE 0 END AS image_exists,
            CASE WHEN l.v IS NULL THEN '{OLD}' ELSE '{NOW}' END AS updated_at
        FROM points p FULL JOIN last l ON l.original_image = p.original_image AND p.energy_type = 'wind'"""),
    "upsert_manual": (upsert_manual, duck_ctes("manual", "farms") + f""",
        wanted AS (SELECT o_orderkey AS row_no, CASE WHEN o_orderstatus = 'O' THEN 'wind' ELSE 'solar' END AS energy_type,
            o_custkey + 1 AS farm_id, o_orderkey + 1 AS recognition_id FROM orders WHERE o_orderpriority <> '5-LOW')
        SELECT coalesce(m.recognition_id * 2, (SELECT max(recognition_id) * 2 FROM manual)
                + row_number() OVER (PARTITION BY m.farm_id IS NULL ORDER BY w.row_no)) AS id,
            w.energy_type, w.farm_id, w.recognition_id,
            CASE WHEN m.farm_id IS NULL THEN '{NOW}' ELSE '{OLD}' END AS created_at, '{NOW}' AS updated_at
        FROM wanted w LEFT JOIN manual m USING (energy_type, farm_id, recognition_id)"""),
    "delete_filtered": (delete_filtered, duck_ctes("farms") + """SELECT id, enterprise_name FROM farms
        WHERE NOT ((enterprise_name ILIKE '%云南%' OR province ILIKE '%云南%') AND (enterprise_name ILIKE '%#0%' OR province ILIKE '%#0%')
            AND confidence < 0.8)"""),
    "delete_all": (delete_all, "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_left FROM customer"),
    "delete_unlinked": (delete_unlinked, duck_ctes("points", "images") + f"""SELECT id, original_image FROM points
        WHERE NOT ((province_name ILIKE '%zhe%' OR province_code ILIKE '%zhe%') AND {UNLINKED})"""),
    "delete_manual": (delete_manual, duck_ctes("manual") + """SELECT recognition_id * 2 AS id, * FROM manual m WHERE NOT EXISTS (
        SELECT 1 FROM orders o WHERE o_orderpriority <> '5-LOW' AND o_orderkey + 1 = m.recognition_id
            AND o_custkey + 1 + (o_orderkey + 1) % 2 = m.farm_id
            AND CASE WHEN o_orderstatus = 'O' THEN 'wind' ELSE 'solar' END = m.energy_type)"""),
    "validate_rows": (validate_rows, duck_ctes("points") + """SELECT id, CASE WHEN longitude = '' THEN 'longitude' ELSE 'city' END
        AS missing_field FROM points WHERE longitude = '' OR image_exists <> 1"""),
    "row_numbers": (row_numbers, """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_no,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders"""),
    "read_order_numbers": (read_order_numbers, """SELECT o_orderkey, o_totalprice,
        row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_no FROM orders"""),
    "import_header_check": (import_header_check, duck_ctes("points") + """SELECT 'in place' AS file,
            '第 ' || min(id) || ' 行缺少必填字段: longitude' AS message FROM points WHERE longitude = ''
        UNION ALL SELECT 'ahead', '导入文件格式不正确，缺少识别数据必要字段'"""),
    "export_file": (export_file, duck_ctes("points") + """SELECT false AS opening, original_image || ',' || province_name || ',' || city || ','
        || longitude || ',' || latitude || ',"' || poi || ',""' || city || '"' AS line FROM points
        UNION ALL SELECT true, '原始图片,省,市,经度,纬度,POI'"""),
    "boundary_bounds": (boundary_bounds, duck_ctes(ring=RING_DUCK) + """SELECT polygon_id % 5 AS boundary_id, min(lng) AS min_lng,
        min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM ring GROUP BY 1"""),
    "unlocated_rows": (unlocated_rows, duck_ctes("farms", "points") + """SELECT 'farm' AS kind, id FROM farms
            WHERE power_type IN ('太阳能发电', '分布式光伏') AND province = '浙江省' AND longitude = ''
        UNION ALL SELECT 'point', id FROM points WHERE energy_type = 'solar' AND province_name = '浙江省' AND longitude = ''"""),
    "search_farms": (search_farms, duck_ctes("farms") + """SELECT id, enterprise_name, confidence FROM farms
        WHERE (enterprise_name ILIKE '%CUSTOMER%' OR province ILIKE '%CUSTOMER%') AND (enterprise_name ILIKE '%云_%'
            OR province ILIKE '%云_%') AND power_type ILIKE '%发电%' AND confidence >= 0.8 AND confidence < 0.9"""),
    "search_postings": (search_postings, duck_ctes("farms") + "SELECT asked.search, id, enterprise_name FROM farms JOIN ("
        "VALUES ('indexed', '%CUSTOMER%', '%云_%', '%发电%', 0.8, 0.9), ('rare', '%mer#000000012%', '%', '%', 0, 9), "
        "('both', '%0001%', '%浙江省%', '%', 0, 0.8), ('short', '%江%', '%', '%风电%', 0, 9), ('wild', '%cust%99%', '%', '%', 0, 9), "
        "('absent', '%不存在的%', '%', '%', 0, 9)) asked(search, one, two, kind, low, high) "
        "ON (enterprise_name ILIKE one OR province ILIKE one) AND (enterprise_name ILIKE two OR province ILIKE two) "
        "AND power_type ILIKE kind AND confidence >= low AND confidence < high"),
    "confidence_bands": (confidence_bands, duck_ctes("farms") + """SELECT CASE WHEN confidence >= 0.9 THEN 'high'
        WHEN confidence >= 0.8 THEN 'medium' ELSE 'low' END AS band, CAST(round(confidence * 100) AS INTEGER) || '%' AS label,
        count(*) AS farms FROM farms GROUP BY ALL"""),
    "recognition_view": (recognition_view, duck_ctes("points", "images") + f"""SELECT id, original_image,
        CASE WHEN NOT {UNLINKED} THEN {URL} END AS image_url FROM points WHERE province_code ILIKE '%yun%'"""),
    "recognition_unlinked": (recognition_unlinked, duck_ctes("points", "images")
                             + f"SELECT id, CAST(NULL AS VARCHAR) AS image_url FROM points WHERE {UNLINKED}"),
    "recognition_page": (recognition_page, duck_ctes("points", "images") + f"""SELECT id, original_image FROM points WHERE {UNLINKED}
        ORDER BY id DESC LIMIT 10 OFFSET 20"""),
    "recognition_deep_page": (recognition_deep_page, duck_ctes("points") + """SELECT id, original_image FROM (SELECT *,
        row_number() OVER (ORDER BY id DESC) AS r, count(*) OVER () AS n FROM points) WHERE (r - 1) // 10 = n // 20"""),
    "recognition_total": (recognition_total, duck_ctes("points", "images")
                          + f"SELECT count(*) AS total FROM points WHERE {UNLINKED}"),
    "farms_page_after": (farms_page_after, duck_ctes("farms")
                         + "SELECT id, enterprise_name FROM farms WHERE id < 100 ORDER BY id DESC LIMIT 20"),
    "farms_of_province": (farms_of_province, duck_ctes("farms") + """SELECT id, province FROM farms
        WHERE power_type IN ('太阳能发电', '分布式光伏') AND contains(province, '浙江')"""),
    "import_image_flags": (import_image_flags, duck_ctes("points", "images") + f"""SELECT id,
        CASE WHEN {UNLINKED} THEN 0 ELSE 1 END AS image_exists,
        CASE WHEN lower(province_code) = 'yunnan' THEN '云南省' ELSE province_code END AS province_name FROM points"""),
    "image_urls": (image_urls, duck_ctes("points", "images")
                   + f"SELECT id, CASE WHEN image_exists = 1 AND NOT {UNLINKED} THEN {URL} END AS image_url FROM points"),
    "export_lines": (export_lines, duck_ctes("points") + """SELECT original_image || ',' || province_name || ',' || city || ','
        || longitude || ',' || latitude || ',"' || poi || ',""' || city || '"' AS line FROM points"""),
    "csv_roundtrip": (csv_roundtrip, duck_ctes("points") + """SELECT original_image AS 原始图片, province_name AS 省, city AS 市,
        longitude AS 经度, latitude AS 纬度, poi || '"' || chr(10) || ',' || city AS POI FROM points"""),
    "registry_csv": (registry_csv, """SELECT CAST(c_custkey AS VARCHAR) AS 地区, c_mktsegment AS 社会统一信用代码,
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_name END AS 企业名称, CAST(NULL AS VARCHAR) AS 发电类型,
        CAST(NULL AS VARCHAR) AS 装机容量, CAST(NULL AS VARCHAR) AS 更新时间 FROM customer, (VALUES (1), (2)) twice(n)"""),
    "finite_coordinates": (finite_coordinates, """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_orderkey AS DOUBLE)
            WHEN '4-NOT SPECIFIED' THEN TRY_CAST('-.' || o_orderkey || 'E1' AS DOUBLE) END AS number,
        CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_orderkey AS DOUBLE) WHEN '2-HIGH' THEN 0
            WHEN '4-NOT SPECIFIED' THEN TRY_CAST('-.' || o_orderkey || 'E1' AS DOUBLE) END AS blank_zero FROM orders"""),
    "distances": (distances, duck_ctes("points") + """SELECT id, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat - 25.0) / 2), 2)
        + cos(radians(25.0)) * cos(radians(lat)) * pow(sin(radians(lng - 102.8) / 2), 2))), 3) AS km
        FROM (SELECT id, TRY_CAST(longitude AS DOUBLE) AS lng, TRY_CAST(latitude AS DOUBLE) AS lat FROM points)"""),
    "ring_bounds": (ring_bounds, duck_ctes(ring=RING_DUCK) + """SELECT polygon_id, count(*) AS corners, min(lng) AS min_lng,
        min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM ring GROUP BY polygon_id"""),
    "point_in_polygon": (point_in_polygon, duck_ctes("points", ring=RING_DUCK, edges="""SELECT a.polygon_id, a.lng, a.lat, b.lng AS lng2,
        b.lat AS lat2 FROM ring a JOIN ring b ON a.polygon_id = b.polygon_id AND b.k = (a.k + 9) % 10""") + HITS),
}

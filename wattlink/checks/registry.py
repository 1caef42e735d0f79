"""Queries from landed JSON to the deduplicated registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlink import constants as K
from wattlink.checks.addresses import strip
from wattlink.checks.fixtures import duck_ctes, spark_view, table
from wattlink.functions import documents as D, measure as M
from wattlink.functions.text import PY_SPACE
from wattlink.operators import registry as R
from wattlink.operators.ranking import in_read_order
from wattlink.plans.jobs import registry_from_pages

NOW = "2026-01-01 00:00:00"

# one JSON document per event; type is text, a list, a number or null, capacity text or a number
DOCUMENTS = """
SELECT event_id, CONCAT('{"data":{"unit":{"creditCode":"', CASE WHEN value < 5 THEN ' NULL ' ELSE CAST(user_id AS STRING) END,
    ' ","names":["公司', CAST(user_id % 7 AS STRING), '"', CASE WHEN value > 60 THEN ',"站点"' ELSE ',""' END, '],"type":',
    CASE event_type WHEN 'click' THEN '"020000"' WHEN 'view' THEN '[null,"050100"]' WHEN 'purchase' THEN '20000'
        WHEN 'signup' THEN '"海上风电"' ELSE 'null' END,
    ',"cap":', CASE WHEN value < 20 THEN CAST(value AS STRING) WHEN value < 50 THEN '"2x50MW"' ELSE '"none"' END,
    ',"on":', CASE WHEN value < 30 THEN 'true' ELSE 'false' END, ',"7":"seven"},"props":', props, '}}') AS body,
    event_type, value, user_id, props
FROM @events@
"""
MAPPING = {
    "社会统一信用代码": "data.unit.creditCode",
    "企业名称": {"mode": "concat", "paths": ["data.unit.names.0", "data.unit.names.1"], "separator": "_"},
    "发电类型": ["data.unit.type"],
    "装机容量": {"paths": ["data.unit.none", "data.unit.cap"]},
}


def observations(spark, sf_dir):
    return spark_view(spark, sf_dir, "observations").select(
        F.col("region").alias("地区"), F.col("credit_code").alias("社会统一信用代码"), F.col("company").alias("企业名称"),
        M.power_type("power_type_raw").alias("发电类型"), M.normalize_capacity("capacity_raw").alias("装机容量"),
        F.col("updated").alias("更新时间"),
    )


def registry_latest(spark, sf_dir):
    return R.latest_records(observations(spark, sf_dir))


def registry_latest_by_max(spark, sf_dir):
    return R.latest_records_by_max(observations(spark, sf_dir))


def registry_newest(spark, sf_dir):
    """All newest records with their place in output order."""
    return in_read_order(R.newest_first(R.latest_records(observations(spark, sf_dir))), "place")


def registry_append(spark, sf_dir):
    old = observations(spark, sf_dir)
    return R.latest_records(R.append_rows(old, old.drop("更新时间"), K.REGISTRY_COLUMNS))


def capacity_mw(spark, sf_dir):
    return spark_view(spark, sf_dir, "observations").select(
        "event_id", "capacity_raw", M.normalize_capacity("capacity_raw").alias("capacity"))


def power_type(spark, sf_dir):
    return spark_view(spark, sf_dir, "observations").select("event_id", M.power_type("power_type_raw").alias("power_type"))


def number_text(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        M.format_number(F.col("l_extendedprice") * F.col("l_discount") / 1000).alias("printed"),
        M.format_number(F.col("l_quantity")).alias("whole"),
    )


def json_extract_map(spark, sf_dir):
    docs = spark_view(spark, sf_dir, DOCUMENTS).select("event_id", D.document(F.col("body")).alias("doc"))
    return R.extract_registry(docs, {"name": "测试", "extraction_mapping": MAPPING}, now=NOW, keep=["event_id"])


def json_paths(spark, sf_dir):
    doc = D.document(F.col("body"))
    at = lambda p: D.as_text(D.value_at(doc, p))
    return spark_view(spark, sf_dir, DOCUMENTS).select(
        "event_id", at("data.props.k").alias("k"), at("data.unit.names.0").alias("first_name"),
        at("data.unit.names.9").alias("beyond"), at("data.unit.7").alias("numeric_key"), at("data.unit.on").alias("switch"),
        at("data.unit.x.y").alias("missing"), at("data.unit.names.-1").alias("negative"),
    )


# pages of 20 orders each, listing the urgent ones; sources take turns
PAGE_OF = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
    CONCAT('S', CAST(CAST(FLOOR(o_orderkey / 20) AS BIGINT) % 3 AS STRING)) AS source,
    CAST(FLOOR(FLOOR(o_orderkey / 20) / 3) AS BIGINT) + 1 AS page FROM @orders@"""
LISTED = "o_orderpriority = '1-URGENT'"
SOURCE = {
    "name": "S0", "fetch_mode": "list_only",
    "list_api": {
        "list_path": "data.rows", "id_field": "guid", "pagination": {"total_path": "data.total", "page_size": 12},
        "json_params": {"criteria": {"match": {"owner_part": ""}}, "params": {"descending": True, "currentPage": 1, "pageSize": 12}},
    },
    "detail_api": {"json_params": {"ref": "{id}", "mode": "1", "nested": ["x-{id}"]}, "id_placeholder": "{id}"},
    "extraction_mapping": {
        "社会统一信用代码": "guid", "企业名称": {"mode": "concat", "paths": ["owner", "site"], "separator": "_"},
        "发电类型": ["type"], "装机容量": "cap",
    },
}


def pages(spark, sf_dir):
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("guid"), F.concat(F.lit("公司"), "o_custkey").alias("owner"),
        F.col("o_orderstatus").alias("site"),
        F.when(F.col("o_orderstatus") == "O", "040000").otherwise("光伏").alias("type"),
        F.concat(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("千瓦")).alias("cap"),
    )
    listed = F.collect_list(F.when(F.expr(LISTED), item))
    return spark_view(spark, sf_dir, PAGE_OF).groupBy("source", "page").agg(
        F.to_json(F.struct(F.struct(listed.alias("rows"), F.count("*").alias("total")).alias("data"))).alias("body")
    )


def pages_prefix(spark, sf_dir):
    return R.complete_pages(R.page_sizes(pages(spark, sf_dir), SOURCE)).select("source", "page", "n_items")


def page_items(spark, sf_dir):
    items = R.page_items(pages(spark, sf_dir), SOURCE)
    return R.item_ids(items, "guid")


def registry_list_only(spark, sf_dir):
    sources = [SOURCE | {"name": f"S{i}"} for i in range(3)]
    return registry_from_pages(pages(spark, sf_dir), sources, now=NOW)


def registry_list_then_detail(spark, sf_dir):
    """Two sources with detail documents and one without, in one run."""
    detailed = SOURCE | {"fetch_mode": "list_then_detail", "extraction_mapping": {
        "社会统一信用代码": "d.code", "企业名称": ["d.none", "d.name"], "发电类型": "d.type", "装机容量": "d.cap"}}
    sources = [detailed, detailed | {"name": "S1"}, SOURCE | {"name": "S2"}]
    details = spark_view(spark, sf_dir, """SELECT CAST(o_orderkey AS STRING) AS id, CONCAT('{"d":{"code":"', CAST(o_custkey AS STRING),
        '","name":"电站', CAST(o_orderkey AS STRING), '","type":"热电联产","cap":', CAST(o_custkey AS STRING), '}}') AS body
        FROM @orders@ WHERE o_orderstatus <> 'P'""")
    details = details.select("id", D.document(F.col("body")).alias("doc"))
    return registry_from_pages(pages(spark, sf_dir), sources, details, now=NOW)


def request_manifest(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("total"))
    return R.request_manifest(totals, SOURCE)


def detail_requests(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit('"'), "c_mktsegment").alias("id"))
    return R.detail_requests(ids, SOURCE)


# --- the same rules in SQL ---------------------------------------------------------------------

A = "[0-9０-９]+(?:\\.[0-9０-９]+)?"
SP = PY_SPACE + "*"


def capacity_sql(c):
    s = f"regexp_replace({strip(c)}, '[, ]', '', 'g')"
    g = lambda p, i=1: f"TRY_CAST(translate(regexp_extract({s}, '{p}', {i}, 'i'), '０１２３４５６７８９', '0123456789') AS DOUBLE)"
    prod = f"({A}){SP}[x×*]{SP}({A}){SP}(mw|kw|兆瓦|千瓦)"
    first = f"{g(prod)} * {g(prod, 2)}"
    amount = f"""coalesce(CASE WHEN lower(regexp_extract({s}, '{prod}', 3, 'i')) IN ('kw', '千瓦') THEN {first} / 1000
        ELSE {first} END, {g(f'({A}){SP}万千瓦')} * 10, {g(f'({A}){SP}(?:mw|兆瓦)')}, {g(f'({A}){SP}(?:kw|千瓦)')} / 1000,
        CASE WHEN regexp_full_match({s}, '{A}') THEN TRY_CAST({s} AS DOUBLE) END)"""
    return f"CASE WHEN lower({strip(c)}) NOT IN ('', 'null') THEN coalesce(format('{{:.15g}}', {amount}), {strip(c)}) END"


def power_type_sql(c):
    codes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.power_type_lookup().items())
    rules = " ".join(f"WHEN regexp_matches({c}, '{'|'.join(words)}') THEN '{v}'" for words, v in K.POWER_TYPE_RULES)
    return (f"CASE WHEN {c} IS NOT NULL AND lower({strip(c)}) NOT IN ('', 'null', 'none') THEN "
            f"coalesce(CASE {strip(c)} {codes} END, CASE {rules} END, {strip(c)}) END")


OBSERVED = f"""SELECT region AS 地区, credit_code AS 社会统一信用代码, company AS 企业名称, {power_type_sql('power_type_raw')} AS 发电类型,
    {capacity_sql('capacity_raw')} AS 装机容量, updated AS 更新时间 FROM observations"""
LATEST = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY 地区, 社会统一信用代码, 企业名称, 发电类型, 装机容量
    ORDER BY try_strptime(更新时间, '%Y-%m-%d %H:%M:%S') DESC NULLS LAST, 更新时间 DESC NULLS LAST) AS rn FROM observed) WHERE rn = 1"""
LATEST_SQL = duck_ctes("observations", observed=OBSERVED) + LATEST
SIZES = f"SELECT source, page, count(*) FILTER ({LISTED}) AS n_items FROM page_of GROUP BY source, page"
WHOLE = """SELECT s.source, s.page, s.n_items FROM sizes s WHERE NOT EXISTS (
    SELECT 1 FROM sizes b WHERE b.source = s.source AND b.page <= s.page AND b.n_items = 0)"""

QUERIES = {
    "registry_latest": (registry_latest, LATEST_SQL),
    "registry_latest_by_max": (registry_latest_by_max, LATEST_SQL),
    "registry_newest": (registry_newest, duck_ctes("observations", observed=OBSERVED, latest=LATEST) + """SELECT *, row_number() OVER (
        ORDER BY try_strptime(更新时间, '%Y-%m-%d %H:%M:%S') DESC NULLS LAST, 地区 NULLS FIRST, 社会统一信用代码 NULLS FIRST,
            企业名称 NULLS FIRST, 发电类型 NULLS FIRST, 装机容量 NULLS FIRST, 更新时间 NULLS FIRST) AS place FROM latest"""),
    "registry_append": (registry_append, LATEST_SQL),
    "capacity_mw": (capacity_mw, duck_ctes("observations")
                    + f"SELECT event_id, capacity_raw, {capacity_sql('capacity_raw')} AS capacity FROM observations"),
    "power_type": (power_type, duck_ctes("observations")
                   + f"SELECT event_id, {power_type_sql('power_type_raw')} AS power_type FROM observations"),
    "number_text": (number_text, """SELECT l_orderkey, l_linenumber, l_extendedprice,
        format('{:.15g}', l_extendedprice * l_discount / 1000) AS printed, format('{:.15g}', l_quantity) AS whole FROM lineitem"""),
    "json_extract_map": (json_extract_map, f"""SELECT event_id, '测试' AS 地区,
        CASE WHEN value >= 5 THEN CAST(user_id AS VARCHAR) END AS 社会统一信用代码,
        '公司' || (user_id % 7) || CASE WHEN value > 60 THEN '_站点' ELSE '' END AS 企业名称,
        CASE event_type WHEN 'click' THEN '火电' WHEN 'view' THEN '太阳能发电' WHEN 'purchase' THEN '20000' WHEN 'signup' THEN '风电' END
            AS 发电类型,
        CASE WHEN value < 20 THEN format('{{:.15g}}', value) WHEN value < 50 THEN '100' END AS 装机容量, '{NOW}' AS 更新时间 FROM events"""),
    "json_paths": (json_paths, """SELECT event_id, json_extract_string(props, '$.k') AS k, '公司' || (user_id % 7) AS first_name,
        CAST(NULL AS VARCHAR) AS beyond, 'seven' AS numeric_key, CASE WHEN value < 30 THEN 'True' ELSE 'False' END AS switch,
        CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS VARCHAR) AS negative FROM events"""),
    "pages_prefix": (pages_prefix, duck_ctes(page_of=PAGE_OF, sizes=SIZES) + WHOLE),
    "page_items": (page_items, duck_ctes(page_of=PAGE_OF)
                   + f"SELECT source, page, CAST(o_orderkey AS VARCHAR) AS id FROM page_of WHERE {LISTED}"),
    "registry_list_only": (registry_list_only, duck_ctes(page_of=PAGE_OF, sizes=SIZES, whole=WHOLE) + f"""
        SELECT source AS 地区, CAST(o_orderkey AS VARCHAR) AS 社会统一信用代码, '公司' || o_custkey || '_' || o_orderstatus AS 企业名称,
            CASE WHEN o_orderstatus = 'O' THEN '风电' ELSE '太阳能发电' END AS 发电类型,
            format('{{:.15g}}', CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) / 1000) AS 装机容量, '{NOW}' AS 更新时间
        FROM page_of JOIN whole USING (source, page) WHERE {LISTED}"""),
    "registry_list_then_detail": (registry_list_then_detail, duck_ctes(page_of=PAGE_OF, sizes=SIZES, whole=WHOLE) + f"""
        SELECT source AS 地区, CAST(o_custkey AS VARCHAR) AS 社会统一信用代码, '电站' || o_orderkey AS 企业名称, '火电' AS 发电类型,
            CAST(o_custkey AS VARCHAR) AS 装机容量, '{NOW}' AS 更新时间
        FROM page_of JOIN whole USING (source, page) WHERE {LISTED} AND source <> 'S2' AND o_orderstatus <> 'P'
        UNION ALL SELECT source, CAST(o_orderkey AS VARCHAR), '公司' || o_custkey || '_' || o_orderstatus,
            CASE WHEN o_orderstatus = 'O' THEN '风电' ELSE '太阳能发电' END,
            format('{{:.15g}}', CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) / 1000), '{NOW}'
        FROM page_of JOIN whole USING (source, page) WHERE {LISTED} AND source = 'S2'"""),
    "request_manifest": (request_manifest, """WITH t AS (SELECT o_orderpriority AS source, count(*) AS total FROM orders GROUP BY 1)
        SELECT source, page, '{"criteria":{"match":{"owner_part":""}},"params":{"descending":true,"currentPage":' || page || ',"pageSize":12}}'
            AS body
        FROM (SELECT source, unnest(generate_series(1, CAST(ceil(total / 12.0) AS BIGINT))) AS page FROM t)"""),
    "detail_requests": (detail_requests, """SELECT id, '{"ref":"' || replace(id, '"', '\\"') || '","mode":"1","nested":["x-'
        || replace(id, '"', '\\"') || '"]}' AS body FROM (SELECT c_name || '"' || c_mktsegment AS id FROM customer)"""),
}

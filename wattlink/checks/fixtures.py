"""Input views over the given tables, as SQL that Spark and DuckDB both read.

A table is written @name@. Coordinates come from integer arithmetic, so both engines see the
same doubles. Categories follow columns of the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FARMS = """
SELECT c_custkey + 1 AS id, c_name AS enterprise_name, CONCAT('站点', CAST(c_nationkey AS STRING)) AS site_name,
       CASE c_mktsegment WHEN 'BUILDING' THEN '风电' WHEN 'MACHINERY' THEN '太阳能发电'
            WHEN 'HOUSEHOLD' THEN '分布式光伏' WHEN 'FURNITURE' THEN '水电' ELSE '风电' END AS power_type,
       CAST(c_nationkey AS STRING) AS capacity,
       CASE WHEN c_nationkey < 8 THEN '云南省' WHEN c_nationkey < 16 THEN '浙江省' ELSE '四川省' END AS province,
       CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(97.5e0 + CAST(((c_custkey % 1000003) * (c_custkey % 1000003) * 7919
            + c_custkey * 104729) % 87000 AS DOUBLE) / 1e4 AS STRING) END AS longitude,
       CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(21.1e0 + CAST(((c_custkey % 1000003) * (c_custkey % 1000003) * 1299
            + c_custkey * 15485) % 80000 AS DOUBLE) / 1e4 AS STRING) END AS latitude,
       CONCAT('站', CAST(c_custkey % 500 AS STRING), '-（东）') AS raw_address,
       CAST(30 + (c_custkey * 13) % 66 AS DOUBLE) / 1e2 AS confidence
FROM @customer@
"""

POINTS = """
SELECT o_orderkey + 1 AS id, CONCAT('tile ', CAST(o_orderkey + 1 AS STRING), '.jpg') AS original_image,
       CASE WHEN o_orderstatus = 'O' THEN 'wind' ELSE 'solar' END AS energy_type,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'yunnan' WHEN '2-HIGH' THEN 'Zhejiang' ELSE '四川' END AS province_code,
       CASE o_orderpriority WHEN '1-URGENT' THEN '云南省' WHEN '2-HIGH' THEN '浙江省' ELSE '四川省' END AS province_name,
       CONCAT('市', CAST(o_custkey % 90 AS STRING)) AS city,
       CASE WHEN o_totalprice < 10000 THEN '' ELSE CAST(97.5e0 + CAST(((o_orderkey % 1000003) * (o_orderkey % 1000003)
            * 6151 + o_orderkey * 32452) % 87000 AS DOUBLE) / 1e4 AS STRING) END AS longitude,
       CASE WHEN o_totalprice < 10000 THEN '' ELSE CAST(21.1e0 + CAST(((o_orderkey % 1000003) * (o_orderkey % 1000003)
            * 3571 + o_orderkey * 86028) % 80000 AS DOUBLE) / 1e4 AS STRING) END AS latitude,
       CASE o_orderstatus WHEN 'F' THEN CONCAT('站', CAST(o_orderkey % 50 AS STRING))
            ELSE CONCAT('镇(站', CAST(o_orderkey % 700 AS STRING), '东)') END AS poi,
       CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS image_exists
FROM @orders@
"""

MANUAL = """
SELECT CASE WHEN o_orderstatus = 'O' THEN 'wind' ELSE 'solar' END AS energy_type,
       o_custkey + 1 AS farm_id, o_orderkey + 1 AS recognition_id
FROM @orders@ WHERE o_orderpriority = '2-HIGH'
"""

# image files on disk: one per order with a returned line
IMAGES = """
SELECT DISTINCT CONCAT('tile ', CAST(l_orderkey + 1 AS STRING), '.jpg') AS name
FROM @lineitem@ WHERE l_returnflag = 'R'
"""

# raw registry observations; the time text is unreadable for one kind of event
OBSERVATIONS = """
SELECT event_id, CASE WHEN value < 50 THEN '云南' ELSE '浙江' END AS region,
       CAST(user_id AS STRING) AS credit_code, CONCAT('公司', CAST(user_id % 7 AS STRING)) AS company,
       CASE event_type WHEN 'click' THEN '020000' WHEN 'view' THEN '050100' WHEN 'purchase' THEN '海上风电'
            WHEN 'signup' THEN '其他' ELSE NULL END AS power_type_raw,
       CASE event_id % 9 WHEN 0 THEN '2x50MW' WHEN 1 THEN '30万千瓦' WHEN 2 THEN '1,500kW' WHEN 3 THEN '12.50'
            WHEN 4 THEN 'null' WHEN 5 THEN '约5' WHEN 6 THEN CONCAT(CAST(event_id AS STRING), ' 千瓦')
            WHEN 7 THEN CONCAT('3×', CAST(value AS STRING), ' mw') ELSE CONCAT(CAST(value AS STRING), '兆瓦') END
            AS capacity_raw,
       CASE WHEN event_type = 'error' THEN CONCAT('无效', CAST(user_id AS STRING))
            ELSE CAST(date_trunc('second', ts) AS STRING) END AS updated
FROM @events@
"""

COMPANIES = """
SELECT id, CASE WHEN nation < 12 THEN '云南' WHEN nation < 20 THEN '浙江' ELSE '四川' END AS region,
       CASE id % 10
         WHEN 0 THEN CONCAT('宁波市电力公司_鄞州区云龙镇', CAST(id AS STRING), '号')
         WHEN 1 THEN '三峡新能源元谋发电有限公司_天子山'
         WHEN 2 THEN CONCAT('昆明某公司_官渡区大板桥街道(云南省昆明市官渡区大板桥街道', CAST(id AS STRING), '号屋顶光伏项目)')
         WHEN 3 THEN '杭州某公司'
         WHEN 4 THEN CONCAT('大理公司（宾川金牛镇仁和村', CAST(nation AS STRING), '0kV分布式光伏）')
         WHEN 5 THEN '某公司（一期）（扩建）'
         WHEN 6 THEN CONCAT('大理 白族自治州公司_建水县', CAST(nation AS STRING), '组A1-2号、文山')
         WHEN 7 THEN CONCAT('浙江省温州市 乐清市公司_北白象镇', CAST(nation AS STRING), '村委会第', CAST(id AS STRING), '村民小组')
         WHEN 8 THEN CONCAT('临沧市云县公司（勐库镇公弄村', CAST(nation AS STRING), '社）_一站_二期')
         ELSE CONCAT('易门龙泉街道公司_', CAST(nation AS STRING), '队') END AS company
FROM (SELECT c_custkey AS id, c_nationkey AS nation FROM @customer@) c
"""

VIEWS = {
    "farms": FARMS, "points": POINTS, "manual": MANUAL, "images": IMAGES, "observations": OBSERVATIONS,
    "companies": COMPANIES,
}
_TABLE = re.compile(r"@(\w+)@")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS.get(name, name)
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir.rstrip('/')}/{m.group(1)}.parquet`", text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def duck_sql(text: str) -> str:
    return _TABLE.sub(r"\1", text)


def duck_ctes(*names: str, **more: str) -> str:
    """WITH list of fixture views, then of further named queries."""
    parts = [f"{n} AS ({duck_sql(VIEWS[n])})" for n in names]
    parts += [f"{n} AS ({duck_sql(q)})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts)

"""Stored pages and trigram postings against the plain ways."""

import pytest
from pyspark.sql import functions as F

from wattlink.operators import reverse as R, views as V
from wattlink.operators.pages import ordered_pages
from wattlink.operators.postings import build_index

FARMS = "id long, enterprise_name string, province string, power_type string, confidence double"


@pytest.fixture(scope="module")
def farms(spark):
    names = ["华能云南风电一场", "Solar ONE 园", "solar two", "a_b%c\\d", "", None, "云", "😀😀😀站", "甲乙丙丁"]
    rows = [(i, names[i % 9], ["云南省", None, "四川省"][i % 3], ["风电", "光伏发电"][i % 2], i % 10 / 10) for i in range(300)]
    return spark.createDataFrame([*rows, (300, "独一无二风场", "云南省", "风电", 0.95)], FARMS)


@pytest.fixture(scope="module")
def index(farms):
    return build_index(farms, blocks=5)


@pytest.mark.parametrize("asked", [
    ("独一无二",), ("solar one",), ("SOLAR",), ("云南 风电",), ("云",), ("s_lar",), ("sol%two",), ("%",), ("",), (None,), ("c\\d",), ("😀😀😀",),
    ("没有这家",), ("独一无二 没有这家",), ("独一无二 云南省", "风电", "high"), (None, "光伏", "low"), ("甲乙丙丁 四川省",),
])
def test_postings_find_what_the_scan_finds(spark, farms, index, asked):
    want = {r["id"] for r in V.search_farms(farms, *asked).collect()}
    got = [r["id"] for r in index.search(spark, *asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert index.search(spark, *asked).columns == farms.columns


def test_rare_term_reads_one_block(spark, index):
    found = index.candidates(spark, ["独一无二"])
    assert [r["_id"] for r in found.collect()] == [300] and index.candidates(spark, ["云", "s_l"]) is None
    plan = index.search(spark, "独一无二")._jdf.queryExecution().simpleString()
    assert "_block#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_empty_tables(spark, farms):
    none = farms.where("false")
    assert build_index(none).search(spark, "云南省").count() == 0
    assert ordered_pages(none).page(spark, 1).count() == 0


@pytest.mark.parametrize("page_no, size", [(1, 10), (2, 7), (15, 20), (16, 20), (17, 20), (31, 10), (1, 1000), (99, 10), (0, 5)])
def test_pages_are_those_of_the_whole_order(spark, farms, page_no, size):
    pages = test_pages_are_those_of_the_whole_order.__dict__.setdefault("pages", ordered_pages(farms, ranges=6))
    ids = sorted((r["id"] for r in farms.collect()), reverse=True)
    begin = (max(page_no, 1) - 1) * size
    assert [r["id"] for r in pages.page(spark, page_no, size).collect()] == ids[begin:begin + size] and pages.total == 301


def test_deep_page_reads_its_range_only(spark, farms):
    pages = ordered_pages(farms, ranges=6)
    read = pages.page(spark, 10, 10)
    files = {r[0] for r in spark.read.parquet(pages.path).select(F.input_file_name()).distinct().collect()}
    scanned = read._jdf.queryExecution().executedPlan().toString()
    assert len(files) > 3 and "_range" in scanned.split("PartitionFilters: [", 1)[1].split("]")[0]
    held = [b - a for a, b in zip(pages.rows_before, pages.rows_before[1:])]
    assert max(held) < 301 / 3


def test_of_several_answers_the_newest_holds(spark):
    points = spark.createDataFrame([("a.jpg", "1", "2")], "`原始图片` string, `经度` string, `纬度` string")
    from wattlink import constants as K
    for c in K.POI_INPUT_COLUMNS:
        if c not in points.columns:
            points = points.withColumn(c, F.lit(""))
    lookup = spark.createDataFrame([("1", "2", "乙", 1), ("1", "2", "甲", 2), ("1", "2", None, None)], "lng string, lat string, poi string, at int")
    assert R.reverse_poi(points, lookup, "at").first()["POI"] == "甲"
    assert R.reverse_poi(points, lookup).first()["POI"] == min("甲", "乙")

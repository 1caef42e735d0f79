"""Scalar rules against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from wattlink import constants as K
from wattlink.functions import address, documents as D, geo, measure as M, text as X
from wattlink.operators.standardize import split_name, standardize_addresses


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    df = spark.createDataFrame([tuple(values.values()) or (None,)], schema)
    row = tuple(df.select(*columns).first())
    return row[0] if len(row) == 1 else row


@pytest.mark.parametrize("given, want", [
    ("2x50MW", "100"), ("50兆瓦", "50"), ("30万千瓦", "300"), ("2×30万千瓦", "300"), ("1,500kW", "1.5"), ("800千瓦", "0.8"),
    ("12.50", "12.5"), ("null", None), (None, None), ("  ", None), ("约5", "约5"), ("3*1.5MW", "4.5"), (" 12 万千瓦 ", "120"),
    ("0.01kW", "1e-05"), ("3 X 4 KW", "0.012"), ("1.1*1.1MW", "1.21"), ("５０兆瓦", "50"), ("约12.5mw左右", "12.5"),
    ("12.5.1", "12.5.1"), ("0.1*3兆瓦", "0.3"),
])
def test_capacity(spark, given, want):
    assert one(spark, M.normalize_capacity("v"), v=given) == want


@pytest.mark.parametrize("given, want", [
    (1.0, "1"), (0.0, "0"), (0.30000000000000004, "0.3"), (1e-5, "1e-05"), (1234567.25, "1234567.25"), (0.0001, "0.0001"),
    (123456789.123456789, "123456789.123457"),
    pytest.param(1e14 + 0.5, "100000000000000", marks=pytest.mark.xfail(reason="a half at the 16th digit rounds up here")),
    (2.5e-10, "2.5e-10"), (-0.5, "-0.5"),
])
def test_number_text(spark, given, want):
    assert spark.range(1).select(M.format_number(F.lit(given))).first()[0] == want == (
        str(int(given)) if given == int(given) else format(given, ".15g"))


@pytest.mark.parametrize("given, want", [
    ("020000", "火电"), ("050100", "太阳能发电"), ("分布式光伏", "太阳能发电"), ("抽水蓄能电站", "水电"), ("风光热电", "火电"),
    ("其他", "其他"), ("None", None), (None, None), (" 040000 ", "风电"), ("风电水电", "风电"), ("核能", "核电"),
])
def test_power_type(spark, given, want):
    assert one(spark, M.power_type("v"), v=given) == want


@pytest.mark.parametrize("doc, want", [
    ('{"t":20000}', "20000"), ('{"t":[null,"","050200"]}', "太阳能发电"), ('{"t":[]}', None), ('{"t":"010000"}', "水电"),
    ('{"t":true}', "1"), ('{"t":null}', None), ("{}", None), ('{"t":[20000.5]}', "20000.5"),
])
def test_power_type_of_document(spark, doc, want):
    got = one(spark, D.mapped_power_type(D.document(F.col("v")), ["t"], M.power_type_lookup()), v=doc)
    assert got == want


def test_power_type_lookup_accepts_both_forms():
    assert M.power_type_lookup({"a": " x ", "y": ["b", 7]}) == {"a": "x", "b": "y", "7": "y"}
    assert M.power_type_lookup()["050200"] == "太阳能发电"


@pytest.mark.parametrize("given, want", [(" NULL ", True), ("", True), (None, True), ("0", False), ("[]", False), ("none", True)])
def test_is_empty(spark, given, want):
    assert one(spark, X.is_empty(F.col("v")), v=given) is want


def test_paths(spark):
    doc = D.document(F.col("v"))
    at = lambda p: D.as_text(D.value_at(doc, p))
    v = '{"a":[{"b":7}],"0":"k","t":true,"d":12.50,"n":null}'
    got = one(spark, at("a.0.b"), at("a.x"), at("a.-1"), at("0"), at("t"), at("d"), at("n"), at("a.1"), v=v)
    assert got == ("7", None, None, "k", "True", "12.5", None, None)
    assert one(spark, D.as_text(D.value_at(doc, "")), v='"x"') == "x"


def test_mappings(spark):
    doc = D.document(F.col("v"))
    v = '{"a":" 甲 ","b":"null","c":"乙"}'
    many = {"mode": "concat", "paths": ["a", "b", "c"], "separator": "_"}
    got = one(spark, D.mapped_text(doc, many), D.mapped_text(doc, ["b", "c"]), D.mapped_text(doc, {"paths": ["x", "a"]}),
              D.mapped_text(doc, {"mode": "concat", "paths": ["b"]}), D.mapped_text(doc, None), v=v)
    assert got == ("甲_乙", "乙", " 甲 ", None, None)


def test_whitespace_and_parts(spark):
    assert one(spark, X.squeeze("v"), X.strip("v"), v="　a  b \n") == ("ab", "a  b")
    assert one(spark, X.parenthesised(F.col("v")), v="甲（A）乙(B)（ ）((c)") == ["A", "B", "c"]
    assert one(spark, X.normalize_poi("v"), v=" 站1-（东）﻿。") == "站1东"
    assert one(spark, X.utf16_length(F.col("v")), v="a😀") == 3
    assert one(spark, X.url_component(F.col("v")), v="a b(1)+é~!*'.jpg") == "a%20b(1)%2B%C3%A9~!*'.jpg"
    assert one(spark, M.confidence_label(F.lit(0.945))) in ("94%", "95%")


@pytest.mark.parametrize("name, want", [
    ("甲公司_站_二（x）", ("甲公司", "站_二", "x", "站_二", "站点名")),
    ("某公司_天子山", ("某公司", "天子山", "", "天子山", "站点名")),
    ("某公司（一期）（扩建）", ("某公司", "", "一期；扩建", "一期；扩建", "括号补充")),
    ("某公司（一期）（A村）_b", ("某公司", "b", "一期；A村", "A村", "括号")),
    ("某公司", ("某公司", "", "", "", "")),
])
def test_split_name(spark, name, want):
    df = spark.createDataFrame([(name,)], "`企业名称` string")
    got = split_name(df).select("主体名称", "站点名称", "括号补充信息", "原始地址片段", "地址来源").first()
    assert tuple(got) == want


def test_address_fragments(spark):
    assert one(spark, address.without_noise("v"), v="屋顶10kva分布式光伏项目，A") == "aA"
    for given, want in (("宾川金牛镇", "宾川县金牛镇"), ("云县", "云县"), ("文山州", "文山市州"), ("宾川县弥渡", "宾川县弥渡县")):
        assert one(spark, address.county_hint(F.lit("云南"), F.col("v")), v=given) == want
    assert one(spark, address.county_hint(F.lit("浙江"), F.col("v")), v="宾川") == "宾川"
    city = address.segment(F.col("v"), K.CITY_SUFFIXES)
    assert one(spark, city, X.remove_first(F.col("v"), city), v="昆明市官渡区") == ("昆明市", "官渡区")
    number = address.house_number("v")
    assert one(spark, number, X.remove_first(F.col("v"), number), v="A12-3号B") == ("12-3号", "AB")
    assert one(spark, number, v="第１２号") == "１２号"


def test_standardized_rows(spark):
    rows = [("云南", "三峡新能源元谋发电有限公司_天子山"),
            ("云南", "昆明某公司_官渡区大板桥街道(云南省昆明市官渡区大板桥街道123号屋顶光伏项目)")]
    out = standardize_addresses(spark.createDataFrame(rows, "`地区` string, `企业名称` string")).collect()
    first, second = out
    assert first["标准化地址"] == "云南省天子山" and first["区县"] == "" and first["社会统一信用代码"] == ""
    parts = [second[c] for c in ("市州", "区县", "乡镇街道", "村社区", "门牌号", "标准化地址")]
    assert parts == ["昆明市", "官渡区", "大板桥街道", "官渡区大板桥街道", "123号",
                     "云南省昆明市官渡区大板桥街道官渡区大板桥街道123号"]


def test_distance(spark):
    km = geo.haversine_km(F.lit(25.0), F.lit(102.8), F.lit(25.1), F.lit(102.8))
    assert round(spark.range(1).select(km).first()[0], 3) == 11.119


@pytest.mark.parametrize("given, plain, zero", [
    ("", None, 0.0), (None, None, None), ("Infinity", None, None), (" 12 ", 12.0, 12.0), ("0x10", 16.0, 16.0),
    ("12d", None, None), (".5", 0.5, 0.5), ("5.", 5.0, 5.0), ("+1e2", 100.0, 100.0), ("1e999", None, None), ("　", None, 0.0),
])
def test_finite_number(spark, given, plain, zero):
    assert one(spark, M.finite_number("v"), M.finite_number("v", True), v=given) == (plain, zero)

"""Queries about text and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattlink import constants as K
from wattlink.checks.fixtures import duck_ctes, spark_view, table
from wattlink.functions import address, text as X
from wattlink.operators.standardize import standardize_addresses
from wattlink.session import spread


def structured(spark, sf_dir):
    rows = spark_view(spark, sf_dir, "companies").select("id", F.col("region").alias("地区"), F.col("company").alias("企业名称"))
    # few bytes and many rules a row: a file is too large a share for one task
    rows = spread(rows, "id", "企业名称")
    return standardize_addresses(rows, keep=["id"])


def standardize_address(spark, sf_dir):
    return structured(spark, sf_dir).select("id", "地区", "企业名称", *K.ADDRESS_COLUMNS)


def text_scalars(spark, sf_dir):
    t = F.col("text")
    segments = X.parenthesised(t)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(X.squeeze(t)).alias("squeezed"),
        F.md5(X.strip(t)).alias("stripped"),
        F.md5(X.normalize_poi(t)).alias("place_text"),
        F.md5(address.without_noise(t)).alias("without_noise"),
        F.size(segments).alias("n_segments"),
        F.md5(F.array_join(segments, "|")).alias("segments"),
        address.has_signal(t).alias("has_signal"),
        address.house_number(t).alias("house_number"),
    )


# --- the same rules in SQL ---------------------------------------------------------------------


def squeeze(c):
    return f"regexp_replace({c}, '{X.PY_SPACE}', '', 'g')"


def strip(c):
    return f"regexp_replace({c}, '^{X.PY_SPACE}+|{X.PY_SPACE}+$', '', 'g')"


def no_noise(c):
    out = squeeze(c)
    for p in K.NOISE_PATTERNS:
        out = f"regexp_replace({out}, '{p}', '', 'gi')"
    return f"regexp_replace({out}, '[、，,;；]+', '', 'g')"


def signal(c):
    return f"regexp_matches({c}, '{'|'.join(K.ADDRESS_SIGNALS)}')"


def drop_first(c, part):
    return (f"CASE WHEN {part} = '' THEN {c} ELSE substr({c}, 1, instr({c}, {part}) - 1) || "
            f"substr({c}, instr({c}, {part}) + length({part})) END")


def hint(region, c):
    arms = " ".join(f"WHEN contains({c}, '{s}') AND NOT contains({c}, '{f}') THEN regexp_replace({c}, '{s}', '{f}')"
                    for s, f in K.COUNTY_FULL_NAMES.items())
    return f"CASE WHEN {region} <> '云南' THEN {c} {arms} ELSE {c} END"


def seg(c, suffixes):
    items = ", ".join(f"regexp_extract({c}, '{X.WORD}+?{s}')" for s in suffixes)
    return f"list_reduce([{items}], lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"


def _take(out, source, suffixes, where="true"):
    return (
        f"SELECT *, CASE WHEN {where} THEN {seg(source, suffixes)} ELSE '' END AS hit FROM {{prev}}",
        f"SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit <> '' THEN hit ELSE {out} END AS {out}, "
        f"{drop_first(source, 'hit')} AS {source}) FROM {{prev}}",
    )


PAREN = X.PARENTHESISED
_STEPS = [
    f"SELECT *, {squeeze('company')} AS name FROM {{prev}}",
    f"SELECT *, regexp_replace(name, '{PAREN}', '', 'g') AS base, regexp_extract_all(name, '{PAREN}', 1) AS segs FROM {{prev}}",
    f"""SELECT *, split_part(base, '_', 1) AS subject,
        CASE WHEN contains(base, '_') THEN substr(base, instr(base, '_') + 1) ELSE '' END AS site,
        array_to_string(segs, '；') AS extra, list_filter(segs, lambda x: {signal('x')})[1] AS seg1 FROM {{prev}}""",
    """SELECT *, coalesce(seg1, nullif(site, ''), extra) AS raw, CASE WHEN seg1 IS NOT NULL THEN '括号'
        WHEN site <> '' THEN '站点名' WHEN extra <> '' THEN '括号补充' ELSE '' END AS src FROM {prev}""",
    f"""SELECT *, CASE region WHEN '云南' THEN '云南省' WHEN '浙江' THEN '浙江省' ELSE '' END AS province,
        {no_noise('raw')} AS clean, '' AS city, '' AS county, '' AS town, '' AS village, '' AS grp FROM {{prev}}""",
    f"SELECT *, {hint('region', 'clean')} AS hinted FROM {{prev}}",
    """SELECT *, CASE WHEN province <> '' AND starts_with(hinted, province) THEN substr(hinted, length(province) + 1)
        ELSE hinted END AS work, CASE WHEN province <> '' AND starts_with(subject, province)
        THEN substr(subject, length(province) + 1) ELSE subject END AS fall FROM {prev}""",
    "SELECT * REPLACE (CASE WHEN region = '云南' THEN coalesce(CASE "
    + " ".join(f"WHEN contains(work, '{f}') THEN '{f}'" for f in K.COUNTY_FULL_NAMES.values())
    + " END, '') ELSE '' END AS county), fall AS fall_whole FROM {prev}",
    f"SELECT * REPLACE ({drop_first('work', 'county')} AS work) FROM {{prev}}",
    *_take("city", "work", K.CITY_SUFFIXES),
    *_take("city", "fall", K.CITY_SUFFIXES, "city = ''"),
    *_take("county", "work", K.COUNTY_SUFFIXES, "county = ''"),
    *_take("county", "fall", K.COUNTY_SUFFIXES, "county = ''"),
    *_take("town", "work", K.TOWN_SUFFIXES),
    *_take("village", "work", K.VILLAGE_SUFFIXES),
    *_take("grp", "work", K.GROUP_SUFFIXES),
    "SELECT *, regexp_extract(work, '\\p{Nd}+(?:-\\p{Nd}+)?号') AS house FROM {prev}",
    f"SELECT * REPLACE ({drop_first('work', 'house')} AS work, CASE WHEN city = '' THEN fall_whole ELSE fall END AS fall) FROM {{prev}}",
    *_take("county", "fall", K.COUNTY_SUFFIXES, "county = ''"),
    *_take("town", "fall", K.TOWN_SUFFIXES, "town = ''"),
    *_take("village", "fall", K.VILLAGE_SUFFIXES, "village = ''"),
    f"""SELECT * REPLACE (CASE WHEN city = county THEN '' ELSE county END AS county,
        CASE WHEN village = '' AND {signal('site')} THEN {no_noise('site')} ELSE village END AS village),
        {no_noise('work')} AS rest FROM {{prev}}""",
    "SELECT *, concat(province, city, county, town, village, grp, house) AS named FROM {prev}",
    """SELECT id, region AS 地区, company AS 企业名称, subject AS 主体名称, site AS 站点名称, extra AS 括号补充信息,
        raw AS 原始地址片段, concat(CASE WHEN named <> '' THEN named ELSE hinted END, rest) AS 标准化地址, province AS 省,
        city AS 市州, county AS 区县, town AS 乡镇街道, village AS 村社区, grp AS 组社, house AS 门牌号,
        src AS 地址来源 FROM {prev}""",
]
def structured_ctes():
    out, prev = {"s0": "SELECT * FROM companies"}, "s0"
    for i, step in enumerate(_STEPS, start=1):
        out[f"s{i}"] = step.replace("{prev}", prev)
        prev = f"s{i}"
    out["structured"] = f"SELECT * FROM {prev}"
    return out


QUERIES = {
    "standardize_address": (
        standardize_address, duck_ctes("companies", **structured_ctes()) + "\nSELECT * FROM structured"),
    "text_scalars": (text_scalars, f"""
        SELECT doc_id, md5({squeeze('text')}) AS squeezed, md5({strip('text')}) AS stripped,
            md5(regexp_replace(regexp_replace(text, '{X.JS_SPACE}', '', 'g'), '{X.POI_PUNCTUATION}', '', 'g')) AS place_text,
            md5({no_noise('text')}) AS without_noise, CAST(len(segs) AS INTEGER) AS n_segments,
            md5(array_to_string(segs, '|')) AS segments, {signal('text')} AS has_signal,
            regexp_extract(text, '\\p{{Nd}}+(?:-\\p{{Nd}}+)?号') AS house_number
        FROM (SELECT *, list_filter(list_transform(regexp_extract_all(text, '{PAREN}', 1), lambda x: {strip('x')}),
                    lambda x: x <> '') AS segs FROM documents)"""),
}

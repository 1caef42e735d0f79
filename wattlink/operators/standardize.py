"""Company names to address parts and a standardized address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlink import constants as K
from wattlink.functions import address as A
from wattlink.functions.measure import literal_lookup
from wattlink.functions.text import blank_to_null, contains_any, join_parts, parenthesised, remove_first, replace_first
from wattlink.functions.text import squeeze, text, without_parentheses
from wattlink.operators.ranking import computed_once


def _either(a: str, b: Column) -> Column:
    return F.when(F.col(a) != "", F.col(a)).otherwise(b)


def split_name(df: DataFrame, name: str = "企业名称") -> DataFrame:
    """Add subject, site, the bracketed additions and the chosen address fragment with its source."""
    base = df.withColumns({"_name": squeeze(name)}).withColumns(
        {"_base": without_parentheses(F.col("_name")), "_segs": parenthesised(F.col("_name"))}
    )
    cut = F.instr("_base", "_")
    split = base.withColumns({
        "主体名称": F.substring_index("_base", "_", 1),
        "站点名称": F.when(cut > 0, F.substring("_base", cut + 1, F.length("_base"))).otherwise(""),
        "括号补充信息": F.array_join("_segs", "；"),
        "_seg": F.try_element_at(F.filter("_segs", lambda s: contains_any(s, K.ADDRESS_SIGNALS)), F.lit(1)),
    })
    site, extra = blank_to_null(F.col("站点名称")), blank_to_null(F.col("括号补充信息"))
    return split.withColumns({
        "原始地址片段": F.coalesce(F.col("_seg"), site, extra, F.lit("")),
        "地址来源": F.when(F.col("_seg").isNotNull(), "括号").when(site.isNotNull(), "站点名")
        .when(extra.isNotNull(), "括号补充").otherwise(""),
    }).drop("_name", "_base", "_segs", "_seg")


def _take(df: DataFrame, out: str, source: str, suffixes: list[str], where: Column | None = None) -> DataFrame:
    """Move a segment from the remaining text `source` to `out`, where `out` is still open."""
    found = A.segment(F.col(source), suffixes)
    df = df.withColumn("_hit", found if where is None else F.when(where, found).otherwise(""))
    return df.withColumns({
        out: F.when(F.col("_hit") != "", F.col("_hit")).otherwise(F.col(out)),
        source: remove_first(F.col(source), F.col("_hit")),
    }).drop("_hit")


def _without_prefix(c: str, prefix: str) -> Column:
    starts = (F.col(prefix) != "") & F.col(c).startswith(F.col(prefix))
    return F.when(starts, F.substring(F.col(c), F.length(prefix) + 1, F.length(c))).otherwise(F.col(c))


def address_parts(df: DataFrame) -> DataFrame:
    """Address parts from 原始地址片段 (working text), with 主体名称 as fallback text.

    Both texts shrink as parts are taken out of them; a part is searched in the fallback only
    while it is missing.
    """
    open_ = lambda c: F.col(c) == ""
    region = squeeze("地区")
    df = df.withColumns({
        "省": text(literal_lookup(region, K.PROVINCE_OF_REGION)),
        "_clean": A.without_noise("原始地址片段"),
        "_fall": squeeze("主体名称"),
        **{c: F.lit("") for c in ("市州", "区县", "乡镇街道", "村社区", "组社", "门牌号")},
    })
    # in steps, each column used more than once being computed before
    df = df.withColumn("_at", A.hint_position(F.col("地区"), F.col("_clean")))
    df = df.withColumns({"_short": A.short_name(F.col("_at")), "_full": A.full_name(F.col("_at"))})
    df = df.withColumn("_hinted", F.coalesce(replace_first(F.col("_clean"), F.col("_short"), F.col("_full")), "_clean"))
    df = df.withColumns({"_work": _without_prefix("_hinted", "省"), "_fall": _without_prefix("_fall", "省")})

    hinted = region == K.COUNTY_HINT_REGION
    df = df.withColumn("区县", F.when(hinted, A.known_county(F.col("_work"))).otherwise(""))
    df = df.withColumn("_work", remove_first(F.col("_work"), F.col("区县")))

    df = df.withColumn("_fall_whole", F.col("_fall"))
    df = _take(df, "市州", "_work", K.CITY_SUFFIXES)
    df = _take(df, "市州", "_fall", K.CITY_SUFFIXES, open_("市州"))
    df = _take(df, "区县", "_work", K.COUNTY_SUFFIXES, open_("区县"))
    df = _take(df, "区县", "_fall", K.COUNTY_SUFFIXES, open_("区县"))
    df = _take(df, "乡镇街道", "_work", K.TOWN_SUFFIXES)
    df = _take(df, "村社区", "_work", K.VILLAGE_SUFFIXES)
    df = _take(df, "组社", "_work", K.GROUP_SUFFIXES)
    df = df.withColumn("门牌号", A.house_number(F.col("_work")))
    df = df.withColumn("_work", remove_first(F.col("_work"), F.col("门牌号")))

    # a still missing city restarts from the whole fallback text (which holds none)
    df = df.withColumn("_fall", F.when(open_("市州"), F.col("_fall_whole")).otherwise(F.col("_fall")))
    df = _take(df, "区县", "_fall", K.COUNTY_SUFFIXES, open_("区县"))
    df = _take(df, "乡镇街道", "_fall", K.TOWN_SUFFIXES, open_("乡镇街道"))
    df = _take(df, "村社区", "_fall", K.VILLAGE_SUFFIXES, open_("村社区"))

    site = F.coalesce(F.col("站点名称"), F.lit(""))
    from_site = open_("村社区") & A.has_signal(site)
    df = df.withColumns({
        "区县": F.when(F.col("市州") == F.col("区县"), "").otherwise(F.col("区县")),
        "村社区": F.when(from_site, A.without_noise(site)).otherwise(F.col("村社区")),
        "_rest": A.without_noise("_work"),
    })
    named = join_parts([F.col(c) for c in ("省", "市州", "区县", "乡镇街道", "村社区", "组社", "门牌号")])
    df = df.withColumn("_named", named)
    df = df.withColumn("标准化地址", F.concat(_either("_named", F.col("_hinted")), "_rest"))
    return df.drop("_clean", "_at", "_short", "_full", "_hinted", "_work", "_fall", "_fall_whole", "_rest", "_named")


def standardize_addresses(registry: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Registry rows to structured rows; other columns named in `keep` travel along."""
    filled = registry.withColumns({c: text(c) for c in K.REGISTRY_COLUMNS if c in registry.columns})
    missing = [c for c in K.REGISTRY_COLUMNS if c not in registry.columns]
    filled = filled.withColumns({c: F.lit("") for c in missing})
    parts = address_parts(computed_once(split_name(filled)))
    # nothing that is asked of the result later may be pushed back through the rules
    return computed_once(parts.select(*(keep or []), *K.STRUCTURED_COLUMNS))

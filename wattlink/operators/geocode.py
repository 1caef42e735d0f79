"""First-success cascade of address queries over a cache of geocoder answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlink import constants as K, schemas
from wattlink.functions.documents import as_text, document, value_at
from wattlink.functions.measure import level_confidence
from wattlink.functions.text import blank_to_null, join_parts, strip, text
from wattlink.operators.ranking import computed_once, first_per_key
from wattlink.session import durable

ROW_KEY = ["地区", "社会统一信用代码", "企业名称", "标准化地址"]
# everything the candidate list depends on
ADDRESS_KEY = [
    "省", "市州", "区县", "乡镇街道", "村社区", "组社", "门牌号", "标准化地址", "原始地址片段", "站点名称",
    "主体名称", "地区",
]


# of an attempt: it succeeded, or nobody has asked it yet
OPEN = "NOT cached OR success"
PENDING = "pending"


def candidate_queries() -> Column:
    """Array of (rank, level, query) in the order of trial, blank queries left out."""
    f = {c: strip(c) for c in ADDRESS_KEY}
    place = [f[c] for c in ("省", "市州", "区县", "乡镇街道", "村社区", "组社", "门牌号")]
    texts = {
        "standard": f["标准化地址"],
        "house": join_parts(place[:7]),
        "group": join_parts(place[:6]),
        "village": join_parts(place[:5]),
        "town": join_parts(place[:4]),
        "county": join_parts(place[:3]),
        "raw": join_parts([f["省"], f["原始地址片段"]]),
        "site": join_parts([*place[:4], f["站点名称"]]),
        "subject_site": join_parts([f["省"], f["主体名称"], f["站点名称"]]),
        "region_site": join_parts([f["地区"], f["站点名称"]]),
    }
    items = [
        F.struct(F.lit(rank).alias("rank"), F.lit(level).alias("level"), query.alias("query"))
        for rank, (level, query) in enumerate(texts.items(), start=1)
    ]
    return F.filter(F.array(*items), lambda c: c["query"] != "")


def address_fingerprint() -> Column:
    """Rows with the same address parts share one cascade."""
    return F.coalesce(F.sha2(F.to_json(F.array(*[strip(c) for c in ADDRESS_KEY])), 256), F.lit(""))


def _with_cascade(structured: DataFrame) -> DataFrame:
    """Add the fingerprint `_fp` and the candidate array `_cands`."""
    return computed_once(structured, _fp=address_fingerprint(), _cands=candidate_queries())


def geocode_candidates(structured: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row and candidate: the `keep` columns, rank, level, query, confidence."""
    return structured.select(*keep, F.explode(candidate_queries()).alias("c")).select(
        *keep, "c.rank", "c.level", "c.query", level_confidence(F.col("c.level")).alias("confidence")
    )


def _attempts(structured: DataFrame, cache: DataFrame) -> DataFrame:
    """Every candidate of every distinct address with its cache entry, if there is one."""
    distinct = _with_cascade(structured).select("_fp", "_cands").dropDuplicates(["_fp"])
    return looked_up(distinct.select("_fp", F.explode("_cands").alias("c")).select("_fp", "c.*"), cache)


def looked_up(tried: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates (column query) with their cache entry, if there is one."""
    answers = cache.select(
        "query", F.coalesce("status", F.lit("")).alias("status"), "message", "lon", "lat", F.lit(True).alias("cached")
    )
    # a query asked for by very many addresses is a hot key on one side of a unique-key lookup:
    # the adaptive skew join splits it
    return tried.join(answers, "query", "left").withColumns({
        "cached": F.coalesce("cached", F.lit(False)),
        "success": F.coalesce(F.col("status") == "success", F.lit(False)),
    })


def geocode_resolve(structured: DataFrame, cache: DataFrame) -> DataFrame:
    """Attach the outcome of the cascade to every row.

    Candidates count in order up to the first that has not failed. If that one succeeded it gives
    the coordinates; if it has no answer yet the row is pending and names the query to ask. Where
    every candidate failed, the last is reported as failed. The cascade runs on distinct addresses
    and is joined back.
    """
    attempts = _attempts(structured, cache)
    open_ = F.expr(OPEN)
    order = [open_.desc(), F.when(open_, F.col("rank")).otherwise(-F.col("rank"))]
    chosen = first_per_key(attempts, ["_fp"], order).select(
        "_fp",
        F.col("query").alias("查询地址"),
        F.when(F.col("success"), text("lon")).otherwise("").alias("经度"),
        F.when(F.col("success"), text("lat")).otherwise("").alias("纬度"),
        F.col("level").alias("定位级别"),
        level_confidence(F.col("level")).alias("经纬度可信度"),
        F.when(F.col("success"), "success").when(~F.col("cached"), PENDING).otherwise("failed").alias("地理编码状态"),
        text("message").alias("地理编码消息"),
    )
    rows = computed_once(structured.drop(*K.GEOCODE_COLUMNS), _fp=address_fingerprint())
    fallback = {c: "" for c in K.GEOCODE_COLUMNS} | {
        "地理编码状态": "failed", "地理编码消息": K.NO_CANDIDATE_MESSAGE,
    }
    out = rows.join(chosen, "_fp", "left").drop("_fp")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fallback.items()})


def geocode_pending(structured: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries worth asking next: per address the first candidate that has not failed, where it
    is not cached yet. Distinct, with the best rank and level that asks for it."""
    open_ = _attempts(structured, cache).where(OPEN)
    front = first_per_key(open_, ["_fp"], [F.col("rank")]).where("NOT cached")
    return _asked(front)


def _asked(front: DataFrame) -> DataFrame:
    return front.groupBy("query").agg(
        F.min(F.struct("rank", "level")).alias("first")
    ).select("query", "first.rank", "first.level")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Landed geocoder responses (query, http_status, body) to cache entries."""
    doc = F.col("_doc")
    at = lambda path: as_text(value_at(doc, path))
    r = computed_once(responses, _doc=document(F.col("body"))).select(
        "query", "http_status", "body", doc.isNotNull().alias("_ok"),
        F.coalesce(at("status"), F.when(value_at(doc, "status").isNotNull(), "None"), F.lit("")).alias("_status"),
        F.coalesce(at("msg"), F.when(value_at(doc, "msg").isNotNull(), "None"), F.lit("")).alias("_msg"),
        at("location.lon").alias("_lon"), at("location.lat").alias("_lat"), at("location.level").alias("_level"),
    )
    http_error = F.col("http_status") >= 400
    refused = F.col("_status") != "0"
    missing = (F.coalesce("_lon", F.lit("")) == "") | (F.coalesce("_lat", F.lit("")) == "")
    success = F.col("_ok") & ~http_error & ~refused & ~missing
    message = (
        F.when(http_error, F.concat(F.lit("HTTP "), F.col("http_status"), F.lit(": "), F.substring("body", 1, 500)))
        .when(~F.col("_ok"), "unreadable response")
        .when(refused, F.coalesce(blank_to_null(F.col("_msg")), blank_to_null(F.col("_status")), F.lit("unknown")))
        .when(missing, "missing location")
        .otherwise(F.coalesce(blank_to_null(F.col("_msg")), F.lit("OK")))
    )
    return r.select(
        "query",
        F.when(success, "success").otherwise("failed").alias("status"),
        message.alias("message"),
        F.when(success, F.col("_lon")).alias("lon"),
        F.when(success, F.col("_lat")).alias("lat"),
        F.when(success, text("_level")).alias("level"),
    )


def new_answers(cache: DataFrame, responses: DataFrame) -> DataFrame:
    """Parsed responses to queries that the cache does not hold. Of several responses to one query the
    one landed last counts (column landed_at, where there is one), then the smallest status and body."""
    landed = [F.col("landed_at").desc_nulls_last()] if "landed_at" in responses.columns else []
    single = first_per_key(responses, ["query"], [*landed, F.col("http_status"), F.col("body")])
    return parse_responses(single).join(cache.select("query"), "query", "left_anti")


def merge_responses(cache: DataFrame, responses: DataFrame) -> DataFrame:
    """Cache plus parsed responses; an answer already in the cache stays."""
    return cache.unionByName(new_answers(cache, responses), allowMissingColumns=True)


def enrich_cache(cache: DataFrame, structured: DataFrame, row_no: str) -> DataFrame:
    """Write into each cache entry the level and the address fields of the last row that asked.

    A row asks its candidates in order up to the first that has not failed, so only candidates up to
    there count as asked.
    """
    about = {
        "original_address": "原始地址片段", "standard_address": "标准化地址", "company_name": "企业名称",
        "site_name": "站点名称", "region": "地区", "power_type": "发电类型",
    }
    rows = _with_cascade(structured).select(row_no, "_cands", "_fp", *[strip(c).alias(n) for n, c in about.items()])
    attempts = _attempts(structured, cache)
    stop = attempts.where(OPEN).groupBy("_fp").agg(F.min("rank").alias("_stop"))
    asked = (
        rows.join(stop, "_fp", "left")
        .select(row_no, *about, "_stop", F.explode("_cands").alias("c"))
        .where("_stop IS NULL OR c.rank <= _stop")
        .select(row_no, *about, "c.rank", F.col("c.level").alias("candidate_level"), "c.query")
    )
    last = first_per_key(asked, ["query"], [F.col(row_no).desc(), F.col("rank").desc()])
    fields = ["candidate_level", *about]
    old = cache.select("query", *[c for c in cache.columns if c != "query"])
    joined = old.alias("o").join(last.select("query", *fields, F.lit(True).alias("_asked")).alias("n"), "query", "left")
    keep = [f"o.{c}" for c in ("status", "message", "lon", "lat", "level")]
    new = [
        F.when(F.col("n._asked"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}") if c in cache.columns else F.lit(None))
        .alias(c)
        for c in fields
    ]
    return joined.select("query", *keep, *new)


def skip_processed(rows: DataFrame, done: DataFrame, row_no: str | None = None) -> DataFrame:
    """Rows not yet in `done` by their key columns; repeated keys in the input keep the first."""
    keyed = computed_once(rows, **{f"_k{i}": strip(c) for i, c in enumerate(ROW_KEY)})
    keys = [f"_k{i}" for i in range(len(ROW_KEY))]
    order = [F.col(row_no)] if row_no else [F.col(c) for c in rows.columns]
    first = first_per_key(keyed, keys, order)
    seen = done.select(*[strip(c).alias(k) for c, k in zip(ROW_KEY, keys)])
    return first.join(seen, keys, "left_anti").drop(*keys)


def _fronts(addresses: DataFrame, cache: DataFrame) -> DataFrame:
    """Of addresses (_fp, _cands) with an open query: that query, and `_rest`, the candidates behind it."""
    tried = F.transform("_cands", lambda c: F.struct(
        c["rank"].alias("rank"), c["level"].alias("level"), c["query"].alias("query"),
        F.filter("_cands", lambda later: later["rank"] > c["rank"]).alias("_rest")))
    open_ = looked_up(addresses.select("_fp", F.explode(tried).alias("c")).select("_fp", "c.*"), cache).where(OPEN)
    return first_per_key(open_, ["_fp"], [F.col("rank")]).where("NOT cached").select("_fp", "rank", "level", "query", "_rest")


def advanced(open_: DataFrame, fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """The addresses that stay open after new answers. Only those whose open query has just failed look
    further, and only at the candidates behind it. `cache` holds the new answers too."""
    news = fresh.select("query", F.coalesce(F.col("status") == "success", F.lit(False)).alias("_won"))
    met = durable(open_.join(news, "query", "left"))
    failed = met.where("NOT _won").select("_fp", F.col("_rest").alias("_cands"))
    return met.where("_won IS NULL").select(*open_.columns).unionByName(_fronts(failed, cache))


def cascade(structured: DataFrame, cache: DataFrame, answer) -> tuple[DataFrame, DataFrame]:
    """Resolve in waves until no query is open or a wave brings no answer. `answer(pending)` returns
    landed responses for the pending queries; answers may be late or partial.

    All candidates meet the cache once, before the first wave. From then on a wave joins its new answers
    with the addresses still open, and the failed ones of these with the cache. What a wave leaves is
    written out, so lineage does not grow. Returns (geocoded, cache); rows whose queries are still
    open are pending, and `geocode_pending` lists those queries."""
    addresses = _with_cascade(structured).select("_fp", "_cands").dropDuplicates(["_fp"])
    open_, known, added = durable(_fronts(addresses, cache)), cache, None
    while True:
        pending = durable(_asked(open_))
        if pending.isEmpty():
            break
        fresh = durable(new_answers(known, answer(pending)))
        if fresh.isEmpty():
            break
        added = durable(added.unionByName(fresh)) if added is not None else fresh
        known = cache.unionByName(added, allowMissingColumns=True)
        open_ = durable(advanced(open_, fresh, known))
    return geocode_resolve(structured, known), known


def cache_frame(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.CACHE_ENTRY)

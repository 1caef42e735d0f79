"""From landed list pages and detail documents to one current row per registered site."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column, DataFrame, functions as F

from wattlink import constants as K
from wattlink.functions.documents import (
    as_text, clean_field, document, mapped_power_type, mapped_text, value_at,
)
from wattlink.functions.measure import normalize_capacity, page_count, power_type_lookup
from wattlink.functions.text import is_empty, strip
from wattlink.operators.ranking import computed_once, first_per_key


def update_stamp(now: str | None = None) -> Column:
    return F.lit(now) if now else F.date_format(F.current_timestamp(), K.TIME_FORMAT)


def extract_registry(docs: DataFrame, source: dict, lookup: dict | None = None, now: str | None = None,
                     doc: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """Registry rows out of VARIANT documents by a source's `extraction_mapping`.

    The mapping is compiled to columns once; rows whose four mapped fields are all missing go.
    """
    mapping = source.get("extraction_mapping") or {}
    if not mapping:
        raise ValueError("source has no extraction_mapping")
    lookup = power_type_lookup(lookup)
    d = F.col(doc)
    rows = computed_once(docs.where(F.try_variant_get(d, "$", "array<variant>").isNull()), **{
        "社会统一信用代码": clean_field(mapped_text(d, mapping.get("社会统一信用代码"))),
        "企业名称": clean_field(mapped_text(d, mapping.get("企业名称"))),
        "发电类型": mapped_power_type(d, mapping.get("发电类型"), lookup),
        "装机容量": normalize_capacity(mapped_text(d, mapping.get("装机容量"))),
    })
    rows = rows.select(
        *(keep or []), F.lit(source.get("name")).alias("地区"), *K.REGISTRY_COLUMNS[1:5], update_stamp(now).alias("更新时间")
    )
    return rows.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in K.REGISTRY_COLUMNS[1:5]]).isNotNull())


def page_items(pages: DataFrame, source: dict) -> DataFrame:
    """Pages (source, page, body) to one row per list item: source, page, doc (VARIANT)."""
    path = (source.get("list_api") or {}).get("list_path", "")
    items = value_at(document(F.col("body")), path, "array<variant>")
    return pages.select("source", "page", F.explode(items).alias("doc"))


def page_sizes(pages: DataFrame, source: dict) -> DataFrame:
    """Pages with the number of list items in each; 0 where there is no list."""
    path = (source.get("list_api") or {}).get("list_path", "")
    items = value_at(document(F.col("body")), path, "array<variant>")
    return pages.withColumn("n_items", F.coalesce(F.size(items), F.lit(0)))


def sizes_of_sources(pages: DataFrame, sources: list[dict]) -> DataFrame:
    """source, page, n_items of the pages of all `sources`, each list read at its source's own path."""
    doc = document(F.col("body"))
    paths: dict[str, list[str]] = {}
    for source in sources:
        paths.setdefault((source.get("list_api") or {}).get("list_path", ""), []).append(source["name"])
    sizes = [F.when(F.col("source").isin(names), F.size(value_at(doc, path, "array<variant>"))) for path, names in paths.items()]
    known = pages.where(F.col("source").isin([s["name"] for s in sources]))
    return known.select("source", "page", F.coalesce(*sizes, F.lit(0)).alias("n_items"))


BUCKET = 1 << 15  # pages of one bitmap


def first_gaps(sized: DataFrame) -> DataFrame:
    """source, first_gap: the page number at which the run of non-empty pages from 1 on ends.

    Good pages are kept as bitmaps of a bucket of pages each, which merge ahead of the shuffle and count a repeated
    page once. Walking the buckets of a source, a 32,768th of its pages, gives the first one that is missing
    or not full, and the lowest clear bit there the gap. One scan, no join and no sort of pages.
    """
    good = (F.col("n_items") > 0) & (F.col("page") >= 1)
    page = F.when(good, F.col("page"))
    bitmaps = sized.groupBy("source", F.bitmap_bucket_number(page).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(page)).alias("bits"))
    octets = F.length(F.regexp_extract(F.hex("bits"), "^(?:FF)*", 0)) / 2  # full ones ahead of the clear bit
    octet = F.conv(F.substring(F.hex("bits"), (2 * octets + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    clear = F.bit_count(octet.bitwiseAND(F.bitwise_not(octet + 1)))  # ones below the lowest clear bit
    run = F.when(F.bitmap_count("bits") == BUCKET, F.lit(BUCKET)).otherwise(octets * 8 + clear).cast("long")
    walked = bitmaps.select("source", F.when(F.col("bucket").isNotNull(), F.struct("bucket", run.alias("run"))).alias("b"))
    # as long as every bucket so far is there and full, the gap is ahead of the next one
    step = lambda end, b: F.when(end == (b["bucket"] - 1) * BUCKET, end + b["run"]).otherwise(end)
    return walked.groupBy("source").agg(F.sort_array(F.collect_list("b")).alias("buckets")).select(
        "source", (F.aggregate("buckets", F.lit(0).cast("long"), step) + 1).alias("first_gap"))


def complete_pages(sized: DataFrame) -> DataFrame:
    """The unbroken run of non-empty pages from page 1 on, per source."""
    gaps = first_gaps(sized.select("source", "page", "n_items"))
    return sized.join(gaps, "source").where("page < first_gap").drop("first_gap")


def item_ids(items: DataFrame, id_field: str, doc: str = "doc") -> DataFrame:
    """Non-empty stripped ids of list items."""
    value = as_text(value_at(F.col(doc), id_field))
    return items.select("source", "page", F.when(~is_empty(value), strip(value)).alias("id")).where("id IS NOT NULL")


def with_details(ids: DataFrame, details: DataFrame) -> DataFrame:
    """Attach the detail document (id, doc) of each id; ids without one drop out."""
    return ids.join(details, "id", "inner")


def template_leaves(params) -> list[tuple[tuple, object]]:
    """(path, value) of every value in a request template that is neither object nor list, in order."""
    leaves, stack = [], [((), params)]
    while stack:
        path, value = stack.pop()
        inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if inner is None:
            leaves.append((path, value))
        else:
            stack.extend(reversed([((*path, key), below) for key, below in inner]))
    return leaves


def page_slot(params) -> tuple | None:
    """Path of the first number under a page-number name, outside lists."""
    names = [(path, value) for path, value in template_leaves(params) if path and all(isinstance(k, str) for k in path)]
    return next((p for p, v in names if p[-1].lower() in K.PAGE_NUMBER_KEYS and isinstance(v, (int, float))), None)


def page_number_path(params) -> str | None:
    """The page slot in dotted form."""
    slot = page_slot(params)
    return None if slot is None else ".".join(slot)


_SLOT = "\ue000slot\ue000"


def _template(params, slots: dict[tuple, object]) -> list[str]:
    """The template as JSON, with other values in some slots, cut at the slot marks."""
    params = copy.deepcopy(params)
    for path, value in slots.items():
        holder = params
        for key in path[:-1]:
            holder = holder[key]
        holder[path[-1]] = value
    return json.dumps(params, ensure_ascii=False, separators=(",", ":")).split(_SLOT)


def request_manifest(totals: DataFrame, source: dict, block: int = 100_000) -> DataFrame:
    """One row per list page to fetch: source, page, body.

    `totals` holds (source, total). Page numbers are generated in blocks, so that a very large
    total neither builds one long array nor stays in one task.
    """
    api = source["list_api"]
    params, paging = api.get("json_params", {}), api.get("pagination")
    slot = page_slot(params) if paging else None
    pages = page_count(F.col("total"), paging.get("page_size", 10)) if paging else F.lit(1).cast("long")
    blocks = (
        totals.where("total > 0").withColumn("_last", pages)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - 1) / block))))
        .repartition("source", "_block")
    )
    numbered = blocks.select(
        "source",
        F.explode(
            F.sequence(F.col("_block") * block + 1, F.least((F.col("_block") + 1) * block, F.col("_last")))
        ).alias("page"),
    )
    if slot:
        # a number takes the place of the quoted mark
        head, tail = _template(params, {slot: _SLOT})
        body = F.concat(F.lit(head[:-1]), F.col("page").cast("string"), F.lit(tail[1:]))
    else:
        body = F.lit("".join(_template(params, {})))
    return numbered.withColumn("body", body)


def detail_requests(ids: DataFrame, source: dict) -> DataFrame:
    """One request body per id, the placeholder replaced in every text value of the template."""
    api = source["detail_api"]
    placeholder = api.get("id_placeholder", "{id}")

    params = api.get("json_params", {})
    texts = {path: value.replace(placeholder, _SLOT) for path, value in template_leaves(params) if isinstance(value, str)}
    pieces = _template(params, texts)
    quoted = F.to_json(F.struct(F.col("id").alias("v")))
    escaped = F.substring(quoted, F.lit(7), F.length(quoted) - 8)
    body = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        body += [escaped, F.lit(piece)]
    return ids.withColumn("body", F.concat(*body))


def parsed_time(c) -> Column:
    return F.try_to_timestamp(c, F.lit(K.TIME_PARSE_FORMAT))


def latest_records(registry: DataFrame) -> DataFrame:
    """Newest row per (地区, 社会统一信用代码, 企业名称, 发电类型, 装机容量); unreadable times last.

    Runs as a group-limited window, so each task sends one row per key to the shuffle.
    """
    keys = K.REGISTRY_COLUMNS[:5]
    order = [parsed_time("更新时间").desc_nulls_last(), F.col("更新时间").desc_nulls_last()]
    return first_per_key(registry, keys, order)


def latest_records_by_max(registry: DataFrame) -> DataFrame:
    """The same result as an aggregate: everything but the time is part of the key."""
    keys = K.REGISTRY_COLUMNS[:5]
    ordered = F.struct(parsed_time("更新时间").alias("at"), F.col("更新时间").alias("text"))
    return registry.groupBy(*keys).agg(F.max(ordered)["text"].alias("更新时间"))


def newest_first(registry: DataFrame) -> DataFrame:
    return registry.orderBy(parsed_time("更新时间").desc_nulls_last(), *K.REGISTRY_COLUMNS)


def append_rows(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Old and new rows together, missing columns as null, in a fixed column order."""
    return old.unionByName(new, allowMissingColumns=True).select(*columns)

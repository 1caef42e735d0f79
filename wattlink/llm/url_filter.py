"""URL filter: a blocked Bloom filter passes possible hits to an exact join.

Two kinds of keys are listed: rules (host and path prefix, with a verdict) and canonical URLs that are
blocked. All keys set eight bits in one 256-bit block of the filter. A URL looks up its own canonical
form and, for rules, every suffix of its host at a label boundary with every prefix of its path whose
length some rule has. What the filter passes meets the listed keys in an equality join, which removes
false positives; of the rules that fit, the longest wins (of equal ones, the longer host).

The filter is a table of blocks. It is broadcast up to `BROADCAST_BYTES`, by its counted size, and
joined by block beyond. Distinct URLs are judged once, so a hot URL costs one row.

Cases: a null URL, or one without `://`, has empty host and path and fits nothing; repeated rows are
judged alike; an empty list blocks nothing; of contradicting equal rules, block wins. Extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wattlink.llm.common import written

BITS, KEY_BITS = 256, 8
BITS_PER_KEY = 16
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without query, fragment and closing slashes; null without a host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    """Places of a key's bits in its block."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(BITS - 1)).cast("int") for j in range(KEY_BITS)]


def bloom(keys: DataFrame) -> tuple[DataFrame, int]:
    """Blocks (block, w0..w3) of the filter over column `key`, and how many blocks there could be."""
    n_blocks = max(1, math.ceil(keys.count() * BITS_PER_KEY / BITS))
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"), F.explode(F.array(*_bits(F.col("key")))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)))
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, one).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
             for w in range(BITS // 64)]
    return bits.groupBy("block").agg(*words), n_blocks


def possible(candidates: DataFrame, filter_: DataFrame, n_blocks: int) -> DataFrame:
    """The candidates (column `key`) whose bits are all set; false positives among them."""
    if n_blocks * (BITS // 8 + 8) <= BROADCAST_BYTES:
        filter_ = F.broadcast(filter_)
    words = F.array(*[F.col(f"w{w}") for w in range(BITS // 64)])
    hit = F.lit(True)
    for bit in _bits(F.col("key")):
        hit = hit & (F.call_function("getbit", F.get(words, F.floor(bit / 64).cast("int")), F.pmod(bit, F.lit(64))) == 1)
    placed = candidates.withColumn("block", _block(F.col("key"), n_blocks))
    return placed.join(filter_, "block").where(hit).select(*candidates.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, other: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, listed. rules: host, path, verdict; listed: url (canonical)."""
    order = F.when(F.col("verdict") == "block", 1).otherwise(0)
    rule_keys = rules.groupBy("host", "path").agg(F.max_by("verdict", order).alias("verdict")).select(
        F.concat(F.lit("r:"), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict",
        F.length("host").alias("host_length"))
    keys = written(rule_keys.unionByName(
        listed.where("url IS NOT NULL").select(F.concat(F.lit("u:"), "url").alias("key")).distinct(), allowMissingColumns=True), "listed-keys")
    filter_, n_blocks = bloom(keys)
    # as many as the label counts of rule hosts and the lengths of rule paths, whatever the number of rules
    depths = [r[0] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    # of a host with very many labels only suffixes as deep as some rule host, so that its keys stay linear in its length
    suffixes = F.filter(
        F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in depths]).cast("array<string>"),
        lambda s: s.isNotNull())
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>"),
        lambda p: p.isNotNull())
    by_rule = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r:"), s, p))))
    own = F.array_compact(F.array(F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path")))))
    candidates = urls.where("host <> ''").select("host", "path", F.explode(F.concat(by_rule, own)).alias("key"))
    hits = possible(candidates, filter_, n_blocks).join(keys, "key")
    length = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "host_length"))
    best = hits.groupBy("host", "path").agg(
        F.max_by("rule", length).alias("rule"), F.max_by("verdict", length).alias("by_rule"),
        F.max(F.col("rule").isNull()).alias("listed"))
    out = parts.join(best, ["host", "path"], "left")
    listed_ = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("by_rule", F.when(listed_, F.lit("block")).otherwise(F.lit(other)))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), listed_.alias("listed"))

"""The registered queries of the operators here, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattlink.llm import (
    byte_pairs, context_mixing, credentials, decontaminate, divergence, hard_negatives, language_id, lattice, periodic, simhash,
    token_counts, url_filter, warc,
)
from wattlink.llm.common import held_out, table, words


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, from the flat files alone."""
    files = token_counts.write(table(spark, sf_dir, "documents"))
    return token_counts.scan(spark, files).select("doc_id", "n_tokens")


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *divergence.COUNTS, "base_failed", "kept")


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), base AS (
  SELECT rid, doc_id, lang, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digit,
         strlen(t) AS n_bytes, length(t) AS n_chars,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), placed AS (
  SELECT rid, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs
), windows AS (
  SELECT rid, unnest(range(1, len(w) - 6)) AS pos, w FROM docs
), texts AS (
  SELECT rid, pos, array_to_string(list_slice(w, pos, pos + 7), ' ') AS win FROM windows
), again AS (
  SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS later
  FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n FROM texts) WHERE n > 1
), repeats AS (
  SELECT rid, sum(CASE WHEN later - pos < 8 THEN later - pos ELSE 8 END) AS n FROM again GROUP BY rid
), langs AS (
  SELECT lang, count(*) AS words FROM placed WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 1000
), common AS (
  SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place
  FROM (SELECT lang, word, count(*) AS n FROM placed JOIN langs USING (lang) WHERE length(word) <= 5 GROUP BY ALL)
  QUALIFY place <= 16
), classes AS (
  SELECT rid, lang, unnest(['upper', 'digit', 'symbol', 'beyond', 'rest']) AS class,
         unnest([n_upper, n_digit, n_symbols, n_bytes - n_chars, n_chars - n_upper - n_digit - n_symbols]) AS n,
         n_bytes FROM base
), class_shares AS (
  SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM classes JOIN langs USING (lang) GROUP BY lang, class
), char_terms AS (
  SELECT rid, s.lang, n / n_bytes AS p, q FROM classes c JOIN class_shares s USING (class) WHERE n_bytes > 0
), found AS (
  SELECT rid, word, count(*) AS n FROM placed WHERE word IN (SELECT word FROM common) GROUP BY ALL
), word_pairs AS (
  SELECT b.rid, c.lang, coalesce(f.n, 0) / b.n_words AS p, c.n / l.words AS q
  FROM base b CROSS JOIN common c JOIN langs l ON l.lang = c.lang LEFT JOIN found f ON f.rid = b.rid AND f.word = c.word
  WHERE b.n_words > 0
), word_terms AS (
  SELECT rid, lang, p, q FROM word_pairs
  UNION ALL SELECT rid, lang, greatest(0, 1 - sum(p)), 1 - sum(q) FROM word_pairs GROUP BY rid, lang
), char_d AS (
  SELECT rid, lang, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END)
         + (CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2)) AS d FROM char_terms GROUP BY rid, lang
), word_d AS (
  SELECT rid, lang, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END)
         + (CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2)) AS d FROM word_terms GROUP BY rid, lang
), nearest AS (
  SELECT c.rid, c.d AS char_d, w.d AS word_d FROM char_d c JOIN word_d w USING (rid, lang)
  QUALIFY row_number() OVER (PARTITION BY c.rid ORDER BY c.d + w.d, lang) = 1
), judged AS (
  SELECT b.*, coalesce(r.n, 0) AS n_rep, x.char_d, x.word_d,
         n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words AS base_failed
  FROM base b LEFT JOIN repeats r USING (rid) LEFT JOIN nearest x USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (NOT EXISTS (SELECT 1 FROM langs)
         OR coalesce(char_d <= 0.33 AND (n_words < 60 OR word_d <= 0.31), false)) AS kept
FROM judged
"""


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.page_records(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (
  SELECT page_id, p, h, min(page_id) OVER (PARTITION BY p) AS first FROM payloads
)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT) >> (15 - 5 * (k % 4))) & 31)::BIGINT + 1, 1) for k in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


# fixed values: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed URLs are the canonical URLs that more than one row of the table leads to."""
    pages = table(spark, sf_dir, "pages")
    url = url_filter.canonical(url_filter.host(F.col("url")), url_filter.path(F.col("url")))
    listed = pages.groupBy(url.alias("url")).count().where("count > 1 AND url IS NOT NULL").select("url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), traps AS (
  SELECT host || regexp_replace(path, '/+$', '') AS url FROM parts WHERE host <> '' GROUP BY 1 HAVING count(*) > 1
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND host || regexp_replace(path, '/+$', '') IN (SELECT url FROM traps) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def op3_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    return language_id.identified(docs, language_id.learned(docs.where(~out), language_id.Fit(min_texts=1)), out)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH texts AS (
  SELECT true AS is_item, item_id AS id, row_number() OVER () AS rid, text FROM benchmark
  UNION ALL SELECT false, doc_id, row_number() OVER (), text FROM documents
), worded AS (
  SELECT is_item, id, rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM texts
), lengths AS (
  SELECT DISTINCT least(len(w), 5) AS n FROM worded WHERE is_item AND len(w) > 0
), starts AS (
  SELECT is_item, id, rid, w, n, unnest(range(1, len(w) - n + 2)) AS pos
  FROM worded CROSS JOIN lengths WHERE len(w) >= n AND (NOT is_item OR n = least(len(w), 5))
), shingles AS (
  SELECT DISTINCT is_item, id, rid, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS s FROM starts
), items AS (
  SELECT *, count(*) OVER (PARTITION BY rid) AS n_item FROM shingles WHERE is_item
), shared AS (
  SELECT d.id AS doc_id, d.rid AS doc_rid, i.id AS item_id, i.rid AS item_rid, i.n_item, count(*) AS n_shared
  FROM items i JOIN shingles d ON NOT d.is_item AND d.n = i.n AND d.s = i.s GROUP BY ALL
)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n_item::BIGINT AS n_item, n_shared / n_item AS containment
FROM shared WHERE 10 * n_shared >= 8 * n_item
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled ids themselves, one array per document; the vocabulary's path is `Vocabulary.load`'s parameter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice.encoded(docs, lattice.Vocabulary.load())


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 7, 2)
    return context_mixing.scored(docs, context_mixing.train(docs.where(~out)), out)


def op10_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one of ten documents, by the hash h of its id, the words from number a on repeat the p words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " "))

    planted = F.transform(F.array(words(F.col("text"))), tail)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, F.lit(""))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.scanned(with_periodic_tails(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenizer file is `Bpe.load`'s parameter."""
    bpe = byte_pairs.Bpe.load()
    coded = byte_pairs.decoded(byte_pairs.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe).drop("text"), bpe)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def whole_vectors(rows: DataFrame) -> DataFrame:
    """id, label, v of the rows whose vector is finite: labels of ids divisible by 7 move on by one, components become
    floor(256 x)."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label"))
    return rows.where(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").alias("id"), moved.cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(whole_vectors(table(spark, sf_dir, "embeddings")), F.pmod("id", F.lit(100)) == 0)


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


QUERIES = {
    "op1_warc": (op1_warc, OP1_SQL),
    "op2_blocked_bloom": (op2_blocked_bloom, OP2_SQL),
    "op3_output_codes": (op3_output_codes, None),
    "op4_decontamination": (op4_decontamination, OP4_SQL),
    "op5_token_counts": (op5_token_counts, None),
    "op6_divergence": (op6_divergence, OP6_SQL),
    "op7_simhash": (op7_simhash, None),
    "op8_lattice": (op8_lattice, None),
    "op9_context_mixing": (op9_context_mixing, None),
    "op10_credentials": (op10_credentials, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_byte_pairs": (op12_byte_pairs, None),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}


def registered() -> dict:
    return QUERIES

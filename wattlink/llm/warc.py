"""WARC archives: writing pages as records, and reading archives back with segment reassembly.

Writing: one response record per page, in chunked HTTP framing; a page whose payload another page with
a smaller id has becomes a revisit of that page. Records longer than `segment_bytes` are cut into a
first segment and continuation records. Spark's text writer puts the record end between records, so
files are committed like any Spark output and nothing is held beyond one record.

Reading: files are split at record starts, in parallel within a file. A block that itself holds the
bytes of a record start is put together again by walking the declared lengths of that file's records.
Continuation records are grouped by their origin, ordered by segment number, and accepted only if the
numbers are 1..n and the total length is as declared; then chunked framing is decoded and the payload
digest verified.

Cases: null html has an empty payload, and empty payloads repeat each other like any others; a null
page_id is never referred to; of repeated rows with the smallest id each is a response; control
characters in URLs become `_`; an empty table writes and reads no records. Extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattlink.llm.common import written
from wattlink.session import scratch_path

VERSION, END, CRLF = "WARC/1.1", "\r\n\r\n", "\r\n"
CHUNK_BYTES, SEGMENT_BYTES = 8192, 65536
# fixed values of the WARC 1.1 format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: four characters out of every five hex digits."""
    h = F.sha1(payload)
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substr(h, 5 * g + 1, F.lit(5)), 16, 10).cast("int"))
    chars = F.transform(five, lambda v: F.concat(*[
        F.substr(F.lit(_BASE32), F.call_function("shiftright", v, F.lit(s)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]))
    return F.array_join(chars, "")


def _pieces(data: Column, size: int) -> Column:
    """A binary cut into pieces of `size` bytes, as strings of those bytes; none if empty."""
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(data, i * size + 1, F.lit(size)).cast("string"))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def first_pages(pages: DataFrame) -> DataFrame:
    """payload_digest, payload_bytes, first: of payloads that several rows have, the smallest page_id."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    # counted by the hex digest: the base-32 form is made of one row per repeated payload
    return written(
        pages.groupBy(F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("payload_bytes"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "payload_bytes", "first"),
        "first-pages")


def records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES,
            date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """value: the bytes of each record without its end, as a string."""
    payload = F.col("payload")
    rows = pages.select("page_id", F.regexp_replace("url", r"[\x00-\x20\x7F]", "_").alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload"))
    rows = rows.join(first_pages(pages), ["sha1", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.lit(False))
    body = F.concat(
        F.array_join(F.transform(_pieces(payload, chunk_bytes), lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(CRLF), p, F.lit(CRLF))), ""),
        F.lit(f"0{CRLF}{CRLF}"))
    head = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Transfer-Encoding: chunked{END}")
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, body)).cast("binary")
    rows = rows.withColumn("revisit", revisit).select(
        "page_id", "url", "first", "revisit", digest(payload).alias("digest"), block.alias("block"),
        F.format_string("<urn:wattlink:%s:%d>", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.monotonically_increasing_id()).alias("id"))
    cut = rows.select("*", F.posexplode(_pieces(F.col("block"), segment_bytes)).alias("at", "piece"))
    total, size = F.octet_length("block"), F.octet_length("piece")
    segmented = total > segment_bytes
    last = segmented & ((F.col("at") + 1) * segment_bytes >= total)

    def field(name: str, value: Column, when: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
        return F.coalesce(line if when is None else F.when(when, line), F.lit(""))

    opening = F.col("at") == 0
    number = F.col("at") + 1
    kind = F.when(~opening, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    own_id = F.when(opening, F.col("id")).otherwise(F.concat(F.rtrim(F.col("id"), F.lit(">")), F.lit(":"), number, F.lit(">")))
    refers = F.format_string("<urn:wattlink:%d>", F.col("first"))
    header = F.concat(
        F.lit(f"{VERSION}{CRLF}"), field("WARC-Type", kind), field("WARC-Record-ID", own_id), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")), field("WARC-Page-ID", F.col("page_id"), opening),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), opening),
        field("WARC-Profile", F.lit(PROFILE), opening & F.col("revisit")),
        field("WARC-Refers-To", refers, opening & F.col("revisit")),
        field("WARC-Segment-Number", number, segmented), field("WARC-Segment-Origin-ID", F.col("id"), ~opening),
        field("WARC-Segment-Total-Length", total, last),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", size), F.lit(CRLF))
    return cut.select(F.concat(header, "piece").alias("value"))


def write(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write archives below `path` (a new folder below the shared one if not given)."""
    path = path or scratch_path(pages.sparkSession, "warc")
    records(pages, **options).write.option("lineSep", END).text(path)
    return path


def _raw_records(spark: SparkSession, path: str) -> DataFrame:
    """value: header and block of every record, cut at record starts and mended where a block holds one.
    The first record of a file keeps its version line."""
    mark = f"{END}{VERSION}{CRLF}"
    lines = spark.read.option("lineSep", mark).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                         F.monotonically_increasing_id().alias("seq"), F.col("value"))
    head = F.substring_index("value", END, 1)
    declared = F.regexp_extract(head, r"(?im)^Content-Length:\s*(\d+)", 1).try_cast("long")
    actual = F.octet_length("value") - F.octet_length(head) - len(END)
    measured = lines.withColumn("declared", declared).withColumn("actual", actual.cast("long"))
    whole = F.coalesce((F.col("actual") == F.col("declared")) | (F.col("actual") == F.col("declared") + len(END)), F.lit(False))
    bad = written(measured.where(~whole).select("file").distinct(), "cut-blocks")
    if bad.isEmpty():
        return measured.select("value")
    fine = measured.join(bad, "file", "left_anti").select("value")
    broken = written(measured.join(bad, "file", "left_semi").withColumn("size", F.octet_length("value")), "cut-blocks")

    def walk(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values(["start", "seq"])
        owner, missing, owners = None, 0, []
        for seq, declared, actual, size in zip(lengths["seq"], lengths["declared"], lengths["actual"], lengths["size"]):
            if owner is not None and missing > 0:
                missing -= len(mark) + size
            else:
                owner, missing = seq, (0 if pd.isna(declared) else declared) - actual
            owners.append(owner)
        return pd.DataFrame({"seq": lengths["seq"], "owner": owners})

    owners = broken.select("file", "start", "seq", "declared", "actual", "size").groupBy("file").applyInPandas(walk, "seq long, owner long")
    joined = broken.join(owners, "seq").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "value"))).alias("parts"))
    return fine.unionByName(joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), mark).alias("value")))


def dechunked(body: bytes | None) -> bytes | None:
    """The payload inside chunked framing; None if the framing is broken."""
    if body is None:
        return None
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        if size < 0 or body[line + 2 + size:line + 4 + size] != b"\r\n":
            return None
        out.append(body[line + 2:line + 2 + size])
        at = line + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per logical record: record_id, record_type, target_uri, page_id, payload_digest,
    refers_to, complete (segments whole and total length right), payload (null for revisits and
    broken records), verified (the payload has the declared digest)."""
    head = F.substring_index("value", END, 1)

    def field(name: str) -> Column:
        # the record's first line is part of the header of a file's first record only
        return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))

    raw = _raw_records(spark, path).withColumn("head", F.regexp_replace(head, "\r\n", "\n"))
    start = F.octet_length(F.substring_index("value", END, 1)) + len(END) + 1
    raw = raw.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Page-ID").cast("long").alias("page_id"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.regexp_extract(field("WARC-Refers-To"), r"([0-9-]+)>$", 1).try_cast("long").alias("refers_to"),
        field("WARC-Segment-Number").try_cast("int").alias("number"), field("WARC-Segment-Origin-ID").alias("origin"),
        field("WARC-Segment-Total-Length").try_cast("long").alias("total"),
        F.substr(F.col("value").cast("binary"), start, field("Content-Length").try_cast("int")).alias("block"))
    kept = ["record_id", "record_type", "target_uri", "page_id", "payload_digest", "refers_to"]
    single = raw.where("number IS NULL").select(*kept, F.lit(True).alias("complete"), "block")
    parts = raw.where("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    # a group is one record: as large as the payload that it becomes
    whole = parts.groupBy("origin").agg(
        F.min_by(F.struct(*kept), "number").alias("first"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("number", F.col("block").cast("string").alias("bytes")))).alias("parts"))
    block = F.array_join(F.transform("parts", lambda p: p["bytes"]), "").cast("binary")
    in_order = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    whole = whole.withColumn("block", block).select(
        "first.*", F.coalesce(in_order & (F.octet_length("block") == F.col("total")), F.lit(False)).alias("complete"), "block")
    every = single.unionByName(whole)

    @F.pandas_udf("binary")
    def payload_of(blocks: pd.Series) -> pd.Series:
        def one(block: bytes | None) -> bytes | None:
            if block is None:
                return None
            head, found, body = bytes(block).partition(b"\r\n\r\n")
            if not found:
                return None
            coding = [x.split(b":", 1)[1].strip().lower() for x in head.split(b"\r\n") if x.lower().startswith(b"transfer-encoding:")]
            return dechunked(body) if coding and coding[-1].endswith(b"chunked") else body

        return blocks.map(one)

    readable = F.col("complete") & (F.col("record_type") == "response")
    out = every.withColumn("payload", payload_of(F.when(readable, F.col("block")))).drop("block")
    return out.withColumn("verified", digest(F.col("payload")) == F.col("payload_digest"))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified of archives of pages; a
    revisit's length and digest are those of the payload it refers to."""
    found = read(spark, path)
    found = written(found.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(digest(F.col("payload"))).alias("payload_digest"),
        "record_type", "refers_to", "verified"), "records")
    sizes = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload_bytes").alias("size"))
    revisits = found.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.col("size")).drop("size")
    return found.where("record_type <> 'revisit'").unionByName(revisits.select(*found.columns))

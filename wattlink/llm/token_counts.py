"""Token counts from flat, unindexed token files: a separator scan with block stitching.

`write` tokenizes texts with a public byte-level BPE vocabulary and writes flat files of 16-bit
little-endian ids, every document closed by the end-of-document id and opened by a preamble of ids
that spell its doc_id (15 bits each, so that no preamble id can be the separator). Spark's text
writer makes the files: a row is the ids of one document and the line separator is the bytes of the
end-of-document id.

`scan` knows only the files. Each is cut into blocks that are read by byte range; a vectorised search
lists the separators of a block. A document may begin in any earlier block, so a prefix scan over
block summaries (last separator of the blocks before, one row per block) carries each block's open
document into it. Work is spread by block, not by file: one huge file is many tasks.

Cases: a null or empty text is a document without tokens; a null doc_id comes back as null; ids after
the last separator of a file are an unterminated document; an odd last byte is ignored; empty files
and folders have no documents; repeated rows are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wattlink.llm.common import written
from wattlink.session import scratch_path

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed values of the vocabulary: its splitting pattern and its free id
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END_OF_DOCUMENT = 50256
PREAMBLE, DIGIT_BITS = 5, 15
BLOCK_TOKENS = 4_000_000
_NULL = 1 << 4  # in the last digit, above the four bits left for an id


def preambles(doc_ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Five ids for every doc_id, the lowest bits first."""
    bits = doc_ids.astype(np.uint64)
    digits = np.stack([(bits >> np.uint64(DIGIT_BITS * k)) & np.uint64((1 << DIGIT_BITS) - 1) for k in range(PREAMBLE)], axis=1)
    digits[null] = [0] * (PREAMBLE - 1) + [_NULL]
    return digits.astype("<u2")


def _read_preambles(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    digits = ids[at[:, None] + np.arange(PREAMBLE)].astype(np.uint64)
    value = np.zeros(len(at), np.uint64)
    for k in range(PREAMBLE):
        value |= (digits[:, k] & np.uint64((1 << DIGIT_BITS) - 1 if k < PREAMBLE - 1 else _NULL - 1)) << np.uint64(DIGIT_BITS * k)
    return value.view(np.int64), digits[:, -1] >= _NULL


def tokenized(docs: DataFrame, ranks_file: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """value: preamble and ids of each text, as the bytes that go into the file."""
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            heads = preambles(b.column(0).fill_null(0).to_numpy(zero_copy_only=False), null)
            rows = [h.tobytes() + (np.array(encode(t), "<u2").tobytes() if t else b"") for h, t in zip(heads, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    return docs.select("doc_id", "text").mapInArrow(run, "value binary")


def write(docs: DataFrame, path: str | None = None, **options) -> str:
    path = path or scratch_path(docs.sparkSession, "tokens")
    separator = END_OF_DOCUMENT.to_bytes(2, "little").decode("latin-1")
    rows = tokenized(docs, **options).select(F.col("value").cast("string"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)
    return path


def _blocks(spark: SparkSession, path: str, separator: int, preamble: bool, block_tokens: int) -> DataFrame:
    """file, block, tokens (of the file), at and ids: positions of the separators of each block and the
    doc_id spelled behind each. The first block of a file has one more, ahead of the file, at -1."""
    files = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / 2).alias("tokens")).where("tokens > 0")
    last = F.floor((F.col("tokens") - 1) / F.lit(block_tokens)).cast("int")
    blocks = files.select(F.col("path").alias("file"), "tokens", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            at, ids = [], []
            for file, tokens, block in zip(*(b.column(k).to_pylist() for k in range(3))):
                if file.startswith("file:"):
                    store, name = fs.LocalFileSystem(), "/" + file[5:].lstrip("/")
                else:
                    store, name = fs.FileSystem.from_uri(file)
                first = block * block_tokens
                size = min(block_tokens, tokens - first)
                ahead = min(PREAMBLE if preamble else 0, tokens - first - size)
                with store.open_input_file(name) as f:
                    data = np.frombuffer(f.read_at(2 * (size + ahead), 2 * first), "<u2")
                found = np.flatnonzero(data[:size] == separator)
                if block == 0:
                    found = np.concatenate([[-1], found])
                at.append(found + first)
                opens = np.flatnonzero(found + 1 + PREAMBLE <= len(data)) if preamble else np.zeros(0, np.int64)
                value, null = _read_preambles(data, found[opens] + 1)
                own = np.ma.masked_all(len(found), np.int64)
                own[opens[~null]] = value[~null]
                ids.append(pa.array(own.data, mask=np.ma.getmaskarray(own)))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *at]))
            spelled = pa.concat_arrays([pa.array([], pa.int64()), *ids])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(1), pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, spelled)],
                ["file", "block", "tokens", "at", "ids"])

    return blocks.select("file", "tokens", "block").repartition(n, "file", "block").mapInArrow(
        run, "file string, block int, tokens long, at array<bigint>, ids array<bigint>")


def scan(spark: SparkSession, path: str, separator: int = END_OF_DOCUMENT, preamble: bool = True,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, doc_id (null without preambles), first (position of the first token), n_tokens, terminated."""
    head = PREAMBLE if preamble else 0
    found = written(_blocks(spark, path, separator, preamble, block_tokens), "separators")
    some = F.size("at") > 0
    summary = found.select(
        "file", "block", "tokens", F.size("at").alias("n"), F.when(some, F.try_element_at("at", F.lit(-1))).alias("last"),
        F.when(some, F.try_element_at("ids", F.lit(-1))).alias("last_id"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.last(F.when(F.col("last").isNotNull(), F.struct("last", "last_id")), ignorenulls=True).over(before)
    carried = summary.select("file", "block", open_.alias("open"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"))
    stitched = found.join(carried, ["file", "block"])
    previous = F.transform("at", lambda x, i: F.when(i == 0, F.struct(F.col("open.last").alias("last"), F.col("open.last_id").alias("last_id")))
                           .otherwise(F.struct(F.get("at", i - 1).alias("last"), F.get("ids", i - 1).alias("last_id"))))
    closed = stitched.select("file", "seen", F.posexplode(F.arrays_zip(previous.alias("open"), F.col("at").alias("at"))).alias("k", "doc")).where("doc.at >= 0")
    closed = closed.select(
        "file", (F.col("seen") + F.col("k") - 1).alias("ordinal"), F.col("doc.open.last_id").alias("doc_id"),
        (F.col("doc.open.last") + 1 + head).alias("first"), (F.col("doc.at") - F.col("doc.open.last") - 1 - head).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = summary.groupBy("file").agg(
        F.max("tokens").alias("tokens"), F.max_by(F.struct("last", "last_id"), "last").alias("open"), F.sum("n").alias("seen")
    ).where(F.col("open.last") < F.col("tokens") - 1)
    left = tail.select(
        "file", (F.col("seen") - 1).alias("ordinal"), F.col("open.last_id").alias("doc_id"), (F.col("open.last") + 1 + head).alias("first"),
        (F.col("tokens") - F.col("open.last") - 1 - head).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(left)

"""Reading the tables, written intermediate tables, and array views of text that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattlink.session import scratch_path

# characters that end a word: blank, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once below the shared folder and continue from the copy: cut lineage, columns and
    statistics for the reader, safe against lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder 0 of nothing: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def thinned(df: DataFrame, rows: int, wanted: int, key: str) -> DataFrame:
    """About four times `wanted` of `rows` rows, by a hash column, so that the first `wanted` of them in
    hash order are found without every task sending that many to the driver."""
    return df.where(F.pmod(F.col(key), F.lit(max(1, rows // (4 * wanted)))) == 0)


def text_blocks(texts: list, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Cut a batch of texts into runs of about `most_bytes` characters, so that array work on a
    run has bounded memory. One long text is a run of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > begin and size + n > most_bytes:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit key over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.full(size - 1, self.base, np.uint64)]).cumprod(dtype=np.uint64)
                self.down = np.concatenate([[np.uint64(1)], np.full(size - 1, self.inverse, np.uint64)]).cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` gives the hash of any span of `values` (uint64)."""
    up, _ = POWERS.upto(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[begin:end], the same wherever the span stands."""
    _, down = POWERS.upto(len(prefix))
    return mix64((prefix[end] - prefix[begin]) * down[begin])


_BYTE_VALUES = mix64(np.arange(256, dtype=np.uint64) + ODD)


class Words:
    """The words of a run of texts as byte spans of one buffer.

    data: lower-cased UTF-8 (A-Z only) with one separator byte after each text; begin, end: span of
    each word; doc: number of its text within the run; sizes: bytes of each text; first: number of the first word of each text,
    with the total at the end.
    """

    def __init__(self, texts: list, separators: np.ndarray = _SPACE):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = _LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
        self.sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        inside = ~separators[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
        self.begin, self.end = edges[0::2], edges[1::2]
        limits = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.first = np.searchsorted(self.begin, limits)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(_BYTE_VALUES[self.data]), self.begin, self.end)

    def strings(self) -> pa.Array:
        """The words in order."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.begin], inside[self.end] = 1, -1
        offsets = np.concatenate([[0], np.cumsum(self.end - self.begin)]).astype(np.int32)
        spelled = self.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        return pa.StringArray.from_buffers(len(self.begin), pa.py_buffer(offsets), pa.py_buffer(spelled))


class HashIndex:
    """Places of known 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        top = (self.keys >> np.uint64(44)).astype(np.int64)
        self.bucket = np.full(1 << 20, -1, np.int32)
        self.bucket[top[::-1]] = np.arange(len(top), dtype=np.int32)[::-1]
        self.crowd = int(np.bincount(top).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the known ones, or -1."""
        at = self.bucket[keys >> np.uint64(44)]
        some = np.flatnonzero(at >= 0)
        at, wanted = at[some], keys[some]
        for _ in range(self.crowd - 1):
            behind = np.flatnonzero(self.keys[at] < wanted)
            if not len(behind):
                break
            at[behind] = np.minimum(at[behind] + 1, len(self.keys) - 1)
        known = self.keys[at] == wanted
        out = np.full(len(keys), -1, np.int32)
        out[some[known]] = self.order[at[known]]
        return out


def added_up(partials: DataFrame) -> DataFrame:
    """Sum blobs of int64 counts by `part`. Rows of one part stream through a task one batch at a
    time, so a part takes the memory of one blob however many tasks sent one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1)):
                values = np.frombuffer(blob.as_buffer(), np.int64)
                if part in sums:
                    sums[part] += values
                else:
                    sums[part] = values.copy()
        for part, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([values.tobytes()], pa.binary())], ["part", "counts"])

    n = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partials.select("part", "counts").repartition(n, "part").mapInArrow(run, "part long, counts binary")


def as_blobs(counts: np.ndarray, width: int, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """Cut a flat count array into numbered blobs of `width` counts, without those that are all zero."""
    for k in range(0, len(counts), width):
        piece = counts[k:k + width]
        if piece.any():
            yield first + k // width, piece.astype(np.int64).tobytes()

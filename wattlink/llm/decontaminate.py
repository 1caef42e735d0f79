"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least `threshold` of its distinct word shingles (five words;
fewer words: the whole item) are among the document's. A fixed-length sketch of a long document
cannot show a short item, so sketches are made of the items: items are partitioned by size, and an
item of q shingles keeps the k(q) smallest hashes of its shingles (a bottom-k MinHash), with k one
more than the number of shingles a match may lack. A containing document then holds at least one
sketch hash, whatever its length, so no match is lost. Each size partition is searched with its own
sketch table, in documents large enough to hold its smallest item. Documents that meet a sketch
hash are verified by exact containment of the shingles' words.

Items are searched in blocks of a bounded number of shingles, each a scan of the documents, so what
travels to the tasks never grows with the benchmark.

Words are runs of letters and digits; ASCII case and punctuation do not count.

Cases: null and empty texts and items without a word match nothing; repeated rows are reported each;
repeated items count as items of their own. Extra columns are ignored by `matches` and pass through
`drop_contaminated`; a row without a doc_id is judged by its own text there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattlink.llm.common import Words, mix64, text_blocks

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_ITEM_SHINGLES = 2_000_000  # of one block of items: about 150 MB in a task with their words
BLOCK_BYTES = 2_000_000
# letters, digits and all bytes of characters outside ASCII make words
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[128:] = _SEPARATORS[48:58] = _SEPARATORS[65:91] = _SEPARATORS[97:123] = False


def _shingle_hashes(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `length` words inside one text, and the number of its text."""
    h, n = w.hashes(), len(w.begin)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n - length + 1, np.uint64)
    for k in range(length):
        out = mix64(out * np.uint64(3) + h[k:n - length + 1 + k])
    whole = w.doc[: n - length + 1] == w.doc[length - 1:]
    return out[whole], w.doc[: n - length + 1][whole]


def _word_shingles(w: Words, doc: int, length: int) -> set:
    data, spans = w.data.tobytes(), slice(w.first[doc], w.first[doc + 1])
    words = [data[a:b] for a, b in zip(w.begin[spans].tolist(), w.end[spans].tolist())]
    return set(zip(*[words[k:] for k in range(length)]))


class Sketches:
    """Sketch tables of one block of items, by shingle length and size partition."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold, self.items, tables = threshold, [], {}
        w = Words([t for _, t in items], _SEPARATORS)
        for i, (item_id, _) in enumerate(items):
            n = int(w.first[i + 1] - w.first[i])
            if not n:
                continue
            length = min(n, SHINGLE)
            shingles = _word_shingles(w, i, length)
            need = math.ceil(threshold * len(shingles) - 1e-9)
            number = len(self.items)
            self.items.append((item_id, shingles, need, length))
            spans = slice(w.first[i], w.first[i + 1])
            own = _Span(w, spans)
            hashes = np.unique(_shingle_hashes(own, length)[0])
            size_class = len(shingles).bit_length()
            entry = tables.setdefault((length, size_class), [need, [], []])
            entry[0] = min(entry[0], need)
            sketch = hashes[: len(shingles) - need + 1]
            entry[1].append(sketch)
            entry[2].append(np.full(len(sketch), number))
        self.tables = []
        for (length, _), (least, sketches, numbers) in sorted(tables.items()):
            hashes, numbers = np.concatenate(sketches), np.concatenate(numbers)
            order = np.argsort(hashes, kind="stable")
            hashes, numbers = hashes[order], numbers[order]
            seen = np.zeros(1 << 16, bool)
            seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((length, least, hashes, numbers, seen))

    def candidates(self, w: Words) -> set[tuple[int, int]]:
        """(text, item number) that share a sketch hash."""
        found, hashed = set(), {}
        for length, least, hashes, numbers, seen in self.tables:
            if length not in hashed:
                hashed[length] = _shingle_hashes(w, length)
            h, doc = hashed[length]
            maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
            low, high = np.searchsorted(hashes, h[maybe]), np.searchsorted(hashes, h[maybe], side="right")
            hit = high > low
            for d, a, b in zip(doc[maybe[hit]].tolist(), low[hit].tolist(), high[hit].tolist()):
                # a document with fewer shingles than the partition's smallest need holds none of it
                if w.first[d + 1] - w.first[d] - length + 1 >= least:
                    found.update((d, k) for k in numbers[a:b].tolist())
        return found

    def search(self, texts: list) -> Iterator[tuple[int, int, int, int]]:
        """(text, item id, shared shingles, shingles of the item) of every contained item."""
        for begin, end in text_blocks(texts, BLOCK_BYTES):
            w = Words(texts[begin:end], _SEPARATORS)
            shingles: dict[tuple[int, int], set] = {}
            for d, k in sorted(self.candidates(w)):
                item_id, own, need, length = self.items[k]
                if (d, length) not in shingles:
                    shingles = {(d, length): _word_shingles(w, d, length)} | {
                        x: y for x, y in shingles.items() if x[0] == d}
                shared = len(own & shingles[d, length])
                if shared >= need:
                    yield begin + d, item_id, shared, len(own)


class _Span:
    """The words of one text of a run, as `_shingle_hashes` takes them."""

    def __init__(self, w: Words, spans: slice):
        self.begin, self.doc, self._h = w.begin[spans], w.doc[spans], w.hashes()[spans]

    def hashes(self) -> np.ndarray:
        return self._h


def item_blocks(items: DataFrame, most: int = BLOCK_ITEM_SHINGLES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `most` words, streamed from Spark partition by partition."""
    block, size = [], 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        block.append((row[0], row[1]))
        size += 1 + len(row[1]) // 4
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: every item contained in every document."""
    schema = "doc_id long, item_id long, n_shared long, n_item long"
    spark, out = docs.sparkSession, None
    for block in item_blocks(items):
        found = docs.select("doc_id", "text").mapInArrow(_finder(spark.sparkContext.broadcast(block), threshold), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _finder(block, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(block.value, threshold)
        for b in batches:
            hits = list(sketches.search(b.column(1).to_pylist()))
            rows = pa.array([h[0] for h in hits], pa.int64())
            columns = [pa.array([h[k] for h in hits], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *columns], ["doc_id", "item_id", "n_shared", "n_item"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that contain no item, with their own columns."""
    out = docs
    for block in item_blocks(items):
        out = out.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), threshold), docs.schema)
    return out


def _clean(block, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(block.value, threshold)
        for b in batches:
            hit = {h[0] for h in sketches.search(b.column("text").to_pylist())}
            yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

    return run

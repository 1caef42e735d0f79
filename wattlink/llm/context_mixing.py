"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens, its words and one end. A token is written as binary decisions: along
the Huffman path of the most frequent training tokens, or of an escape and then the token's bytes.
Each decision is predicted by three counters, looked up by the decision alone, by the decision and a
hash of the symbol before, and by the decision and a hash of the two symbols before. Their log-odds
are mixed by weights that a gate picks, the confidence of the two hashed counters; the mixed
probability is refined by an adaptive map. Weights and map learn online, text by text: they start at
values fitted on all training texts, each predicted by the counts of all other texts, and
move after every window of the text. The sum of log-probabilities is the score, in bits per byte too.

Counters are summed over all training texts, at every size, into hashed tables of fixed size. The base score needs the exact count of every token: counts
of the `HEAD` most frequent tokens travel to the tasks, all others meet the texts in a join.

Cases: a null text is an empty one, whose only token is the end; without training texts every token
is spelled with even odds; repeated rows are scored each, and the ids of rows are not used as keys.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattlink.llm.common import HashIndex, Words, added_up, as_blobs, text_blocks, written

HEAD = 1 << 18            # most tokens that travel to the tasks
TABLE_BITS, BLOB = 20, 1 << 14
LEVELS = 33               # of a log-odds in the counts that the starting weights are fitted to, by half log-odds
BLOCK_CHARS = 250_000
TOKEN_CHARS = 1_000_000   # texts whose tokens are counted together
COUNT_CHARS = 120_000     # texts counted together: arrays that stay in a processor's cache
SMALL = 256               # counts below it, a power of two, have their log-odds in a table
WINDOWS = (32, 64, 128, 256, 512)  # symbols between updates; the last repeats
GATES, STEPS = 16, 25     # weight sets; cells of the adaptive map, by half log-odds
RATE, DAMP, PRIOR = 0.3, 32.0, 20.0
_LIMIT = 8.0


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only), then the end, which is the empty word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(b"")
    return found


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of decisions of each symbol, and all decisions from the root to each: inner node, bit.
    A lone symbol needs none."""
    n = len(weights)
    heap = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = np.full(2 * n - 1, -1, np.int32)
    bit = np.zeros(2 * n - 1, np.uint8)
    for inner in range(n, 2 * n - 1):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = inner
        bit[b] = 1
        heapq.heappush(heap, (wa + wb, inner))
    depth, levels, at = np.zeros(n, np.int64), [], np.arange(n)
    active = np.arange(n)
    while len(active := active[parent[at] >= 0]):
        at = at[parent[at] >= 0]
        levels.append((active, parent[at] - n, bit[at]))
        depth[active] += 1
        at = parent[at]
    ends = np.cumsum(depth)
    nodes, bits = np.zeros(int(depth.sum()), np.int32), np.zeros(int(depth.sum()), np.uint8)
    for k, (who, node, turn) in enumerate(levels):
        nodes[ends[who] - 1 - k], bits[ends[who] - 1 - k] = node, turn
    return depth, nodes, bits


@dataclass
class Code:
    """Symbols: head tokens, escape, 256 bytes, end of spelling, beginning of text."""

    head: list[bytes]
    log_counts: np.ndarray  # log10(count + 1) of head tokens
    path_at: np.ndarray     # by symbol: first decision, and the end of the last
    path_node: np.ndarray
    path_bit: np.ndarray
    n_nodes: int
    _index: HashIndex | None = None  # made once in each process that asks

    @classmethod
    def build(cls, head: list[tuple[bytes, int]], escaped: int, byte_counts: np.ndarray) -> Code:
        word_depth, word_nodes, word_bits = huffman([c for _, c in head] + [max(escaped, 1)])
        byte_depth, byte_nodes, byte_bits = huffman([int(c) + 1 for c in byte_counts])
        at = np.concatenate([[0], np.cumsum(np.concatenate([word_depth, byte_depth]))])
        nodes = np.concatenate([word_nodes, byte_nodes + np.int32(len(head))])
        bits = np.concatenate([word_bits, byte_bits])
        return cls([w for w, _ in head], np.log10([c + 1 for _, c in head]), at, nodes, bits, len(head) + 256)

    @property
    def escape(self) -> int:
        return len(self.head)

    @property
    def end(self) -> int:
        """Number of the end among the head tokens, -1 if it is not one of them."""
        return self.head.index(b"") if b"" in self.head else -1

    def index(self) -> HashIndex:
        if self._index is None:
            # a word of the head is one run of bytes without blanks; the end, which is empty, is no word
            hashes = np.zeros(len(self.head), np.uint64)
            w = Words([t.decode("utf-8", "surrogatepass") for t in self.head])
            hashes[w.doc] = w.hashes()
            self._index = HashIndex(hashes)
        return self._index

    def tally(self, n: np.ndarray, total: np.ndarray) -> None:
        """Add the zeros and ones of each node to `total`, at 2 * node + bit, for `n` of each symbol."""
        depth = np.diff(self.path_at)[:len(n)]
        path = slice(0, int(depth.sum()))
        np.add.at(total, self.path_node[path].astype(np.int64) * 2 + self.path_bit[path], np.repeat(n, depth))

    def slots(self) -> int:
        """Size of the three counter tables together."""
        return self.n_nodes + 2 * (1 << TABLE_BITS)


class Symbols:
    """The symbol stream of a run of texts, in windows: all texts' first windows, then all second ones. Without
    `windows`, text after text."""

    def __init__(self, code: Code, index: HashIndex, texts: list, windows: bool = True):
        w = Words(texts)
        self.n_bytes = w.sizes
        n_words = np.diff(w.first)
        self.n_tokens = n_words + 1
        self.doc_of_token = np.repeat(np.arange(len(texts)), self.n_tokens)
        ids = np.full(len(self.doc_of_token), code.end, np.int32)
        lengths = np.zeros(len(ids), np.int64)
        begin = np.zeros(len(ids), np.int64)
        own = np.arange(len(w.begin)) + w.doc  # one end stands between the words of neighbouring texts
        ids[own], lengths[own], begin[own] = index.find(w.hashes()), w.end - w.begin, w.begin
        self.ids = ids
        out = np.flatnonzero(ids < 0)
        lengths = lengths[out]
        shift = np.repeat(begin[out] - (np.cumsum(lengths) - lengths), lengths)
        spelled = w.data[shift + np.arange(len(shift))]
        self.outside = (spelled, lengths)
        size = np.ones(len(ids), np.int64)
        size[out] = lengths + 2
        at = np.cumsum(size) - size
        symbol = np.zeros(int(size.sum()), np.int32)
        symbol[at] = np.where(ids < 0, code.escape, ids)
        place = np.repeat(at[out] + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(spelled))
        symbol[place] = spelled.astype(np.int32) + (code.escape + 1)
        symbol[at[out] + lengths + 1] = code.escape + 257
        doc = np.repeat(self.doc_of_token, size)
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        back, earlier = [], symbol
        for _ in range(4):  # the symbols one to four before, the beginning of the text before all
            earlier = np.concatenate([np.full(1, code.escape + 258, np.int32), earlier[:-1]])
            earlier[begin] = code.escape + 258
            back.append(earlier)
        doc = doc.astype(np.int32)
        one, two, three, four = (x.view(np.uint32) for x in back)
        if windows:
            n = np.bincount(doc, minlength=len(texts))
            position = np.arange(len(symbol)) - np.repeat(np.cumsum(n) - n, n)
            edges = np.cumsum(WINDOWS)
            window = np.where(position < edges[-1], np.searchsorted(edges, position, side="right"),
                              len(WINDOWS) + (position - edges[-1]) // WINDOWS[-1])
            order = np.argsort(window.astype(np.uint16) if window.max(initial=0) < 1 << 16 else window, kind="stable")
            self.window = window[order]
            symbol, doc, one, two, three, four = (x[order] for x in (symbol, doc, one, two, three, four))
        # a spelled byte looks at two and at four symbols before, a token at one and at two
        pair = (one * np.uint32(0x9E3779B1) + np.uint32(1)) ^ (two * np.uint32(0x85EBCA77))
        deep = (pair * np.uint32(0xC2B2AE3D)) ^ (three * np.uint32(0x27D4EB2F)) ^ (four * np.uint32(0x165667B1))
        spelled = symbol > code.escape
        near, far = np.where(spelled, pair, one * np.uint32(0x9E3779B1)), np.where(spelled, deep, pair)
        # decisions of every symbol
        self.code, self.symbol, at = code, symbol, code.path_at[symbol]
        width = code.path_at[symbol + 1] - at
        ends = np.cumsum(width)
        take = np.repeat(at - (ends - width), width)
        take += np.arange(len(take))
        self.node, self.bit = (np.take(path, take, mode="clip") for path in (code.path_node, code.path_bit))
        self.doc = np.repeat(doc, width)
        salt = self.node.view(np.uint32) * np.uint32(0xD6E8FEB9)
        self.slot1 = _slot(np.repeat(near, width), salt, code.n_nodes)
        self.slot2 = _slot(np.repeat(far, width), salt, code.n_nodes + (1 << TABLE_BITS))
        if not windows:
            return
        last = np.flatnonzero(np.concatenate([self.window[1:] != self.window[:-1], [True]])) if len(symbol) else np.zeros(0, np.int64)
        self.cuts = [0, *ends[last].tolist()]

    def outside_strings(self) -> pa.Array:
        """The tokens that are not in the head, in order."""
        spelled, lengths = self.outside
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(spelled))

    def tally(self, total: np.ndarray) -> None:
        """Add the zeros and ones of each slot to `total`, at 2 * slot + bit."""
        self.code.tally(np.bincount(self.symbol), total)
        packed = np.zeros(len(total) // 2, np.int64)
        self.tally_contexts(packed)
        unpack(packed, total)

    def tally_contexts(self, packed: np.ndarray) -> None:
        """The part of `tally` that the symbols' numbers alone do not tell, to one number for each slot."""
        one = np.take(_ONE, self.bit)
        for slot in (self.slot1, self.slot2):
            np.add.at(packed, slot, one)


_ONE = np.array([1, 1 << 32])  # zeros are counted in the lower half of a number, ones in the upper one


def unpack(packed: np.ndarray, total: np.ndarray) -> None:
    total[0::2] += packed & 0xFFFFFFFF
    total[1::2] += packed >> 32


def _slot(context: np.ndarray, salt: np.ndarray, first: int) -> np.ndarray:
    x = context  # is changed: arrays of this length are better used again than made
    x ^= salt
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x >>= np.uint32(32 - TABLE_BITS)
    return np.add(x, first, dtype=np.int64)


def encoded(c: np.ndarray) -> np.ndarray:
    """Log-odds of rows of zeros and ones counted; the last two bits of each float are its trust, 0 to 3."""
    odds = np.clip(np.log((c[:, 1] + 0.4) / (c[:, 0] + 0.4)), -_LIMIT, _LIMIT).astype(np.float32)
    trust = np.searchsorted([1, 4, 32], c.sum(axis=1), side="right").astype(np.uint32)
    return ((odds.view(np.uint32) & np.uint32(0xFFFFFFFC)) | trust).view(np.float32)


def _gate(x: np.ndarray) -> np.ndarray:
    bits = x.view(np.uint32)
    return (((bits[1] & 3) << 2) | (bits[2] & 3)).view(np.int32)


_small: np.ndarray | None = None


def encoded_pairs(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """`encoded` of whole counts of zeros and ones, small ones out of a table."""
    global _small
    if _small is None:
        _small = encoded(np.stack(np.divmod(np.arange(SMALL * SMALL), SMALL), axis=1))
    large = np.flatnonzero((zeros | ones) >= SMALL)  # their sum is large enough for the highest trust
    z, o = zeros[large], ones[large]
    at = zeros * SMALL + ones
    at[large] = 0
    out = np.take(_small, at, mode="clip")
    odds = np.clip(np.log((o + 0.4) / (z + 0.4)), -_LIMIT, _LIMIT).astype(np.float32)
    out[large] = (odds.view(np.uint32) | np.uint32(3)).view(np.float32)
    return out


def plain(a: np.ndarray) -> np.ndarray:
    """The same array by numpy's own object of its type. An unpickled array has another one, with which ufunc.at takes
    about ten times as long."""
    return a.view(a.dtype.type)


def without_own(s: Symbols, counts: np.ndarray) -> Iterator[np.ndarray]:
    """For each of the three slots, rows of zeros and ones of the decisions of counted texts, one after another in `s`, as
    they are without the text's own counts. `counts` is as before afterwards."""
    packed = counts.dtype == np.int32  # both counts of a slot are then one number, little end first
    flat = counts.view(np.int64).reshape(-1) if packed else plain(counts).reshape(-1)
    one = np.take(_ONE, s.bit) if packed else np.ones(len(s.bit), np.int64)
    edges = np.searchsorted(s.doc, np.arange(len(s.n_tokens) + 1)).tolist()
    for slot in (s.node.astype(np.int64), s.slot1, s.slot2):
        own = slot if packed else 2 * slot + s.bit
        left = np.empty((len(slot), 2), counts.dtype)
        looked, out = (flat, left.view(np.int64).reshape(-1)) if packed else (counts, left)
        for a, b in zip(edges[:-1], edges[1:]):
            np.subtract.at(flat, own[a:b], one[a:b])
            np.take(looked, slot[a:b], axis=0, out=out[a:b], mode="clip")
            np.add.at(flat, own[a:b], one[a:b])
        yield left


def left_out(s: Symbols, counts: np.ndarray) -> np.ndarray:
    """Inputs of the decisions of counted texts, each as they are without the text's own counts."""
    return np.stack([encoded_pairs(*left.T) for left in without_own(s, counts)])


def tally_left_out(s: Symbols, counts: np.ndarray, total: np.ndarray) -> None:
    """What `tally_inputs` adds for `left_out`, without the log-odds themselves where their next half is clear."""
    gate, cell = (np.zeros(len(s.node), np.float32) for _ in range(2))  # whole numbers below 2^24
    for k, left in enumerate(without_own(s, counts)):
        c = left.astype(np.float32)
        c += np.float32(0.4)
        if k:
            seen = c[:, 0] + c[:, 1]  # the counts and 0.8
            gate *= np.float32(4)
            for least in (1, 4, 32):
                gate += seen > np.float32(least + 0.5)
        twice = c[:, 1] / c[:, 0]
        np.log(twice, out=twice)
        twice *= np.float32(2)
        half = np.rint(twice)
        twice -= half
        near = np.flatnonzero(np.abs(twice, out=twice) > np.float32(0.4999))  # single precision does not tell
        half[near] = np.rint(2 * encoded_pairs(*left[near].T))
        np.clip(half, -(LEVELS // 2), LEVELS // 2, out=half)
        cell *= np.float32(LEVELS)
        cell += half
        cell += np.float32(LEVELS // 2)
    gate *= np.float32(LEVELS**3)
    cell += gate
    cell *= np.float32(2)
    cell += s.bit
    np.add.at(total, cell.astype(np.int64), 1)


def tally_inputs(x: np.ndarray, bit: np.ndarray, total: np.ndarray) -> None:
    """Add decisions to `total` by gate, the three log-odds to the next half, and bit."""
    cell = _gate(x)
    for row in x:
        cell = cell * np.int32(LEVELS) + np.rint(2 * np.clip(row, -_LIMIT, _LIMIT)).astype(np.int32) + np.int32(LEVELS // 2)
    np.add.at(total, cell.astype(np.int64) * 2 + bit, 1)


@dataclass
class Model:
    code: Code
    counters: np.ndarray  # log-odds by slot; the last two bits of each float are its trust, 0 to 3
    weights: np.ndarray   # GATES x 3
    refine: np.ndarray    # STEPS

    def inputs(self, s: Symbols) -> tuple[np.ndarray, np.ndarray]:
        x = np.empty((3, len(s.node)), np.float32)
        for row, slot in zip(x, (s.node, s.slot1, s.slot2)):
            np.take(self.counters, slot, out=row, mode="clip")
        return x, _gate(x)

    def fit(self, total: np.ndarray) -> None:
        """Starting weights by Newton steps for each gate, and the starting map, from `tally_inputs` of all decisions."""
        counts = total.reshape(-1, 2)
        met = np.flatnonzero(counts.any(axis=1))
        seen, ones = counts[met].sum(axis=1).astype(np.float64), counts[met, 1].astype(np.float64)
        gate, *at = np.unravel_index(met, (GATES, LEVELS, LEVELS, LEVELS))
        x = (np.stack(at) - LEVELS // 2) / 2
        z = np.zeros(len(met))
        for g in range(GATES):
            own = np.flatnonzero(gate == g)
            a, n, y, w = x[:, own], seen[own], ones[own], self.weights[g].astype(np.float64)
            start = w.copy()
            for _ in range(8):
                p = 1 / (1 + np.exp(-np.clip(w @ a, -30, 30)))
                slope = a @ (y - n * p) - 10.0 * (w - start)
                w = np.clip(w + np.linalg.solve((a * (n * p * (1 - p))) @ a.T + 10.0 * np.eye(3), slope), -1.0, 2.0)
            self.weights[g] = w
            z[own] = w @ a
        cell = _cell(z)
        n, k = (np.bincount(cell, weights=v, minlength=STEPS) for v in (seen, ones))
        self.refine = (k + PRIOR * self.refine) / (n + PRIOR)

    def score(self, s: Symbols, n_texts: int) -> np.ndarray:
        """Natural log-probability of each text."""
        x, gate = self.inputs(s)
        w = [np.tile(self.weights[:, k].astype(np.float32), n_texts) for k in range(3)]
        n_map, ones_map = np.full(n_texts * STEPS, PRIOR), np.tile(self.refine * PRIOR, n_texts)
        one = np.float32(1)
        out, texts = np.zeros(n_texts), np.arange(n_texts + 1, dtype=np.int32)
        for k, (a, b) in enumerate(zip(s.cuts[:-1], s.cuts[1:])):
            doc, y = s.doc[a:b], s.bit[a:b]
            own = doc.astype(np.intp)
            cell = own * STEPS
            own *= GATES
            own += gate[a:b]
            part = x[:, a:b]
            z = np.take(w[0], own, mode="clip") * part[0]
            for i in (1, 2):
                more = np.take(w[i], own, mode="clip")
                more *= part[i]
                z += more
            cell += _cell(z)
            p = np.exp(np.negative(z, out=z), out=z)
            p += one
            np.divide(one, p, out=p)
            final = np.take((ones_map / n_map).astype(np.float32), cell, mode="clip")
            final += p
            final *= np.float32(0.5)
            final -= y ^ 1  # of a zero the probability left
            np.clip(np.abs(final, out=final), np.float32(1e-6), one, out=final)
            edges = np.searchsorted(doc, texts)
            some = np.flatnonzero(edges[1:] > edges[:-1])
            out[some] += np.add.reduceat(np.log(final, out=final), edges[some], dtype=np.float64)
            if b == s.cuts[-1]:
                break
            # what this window teaches holds from the next one on, for the texts that have one
            upto = int(np.searchsorted(doc, s.doc[b:s.cuts[k + 2]].max(), side="right"))
            own, cell, y, part = own[:upto], cell[:upto], y[:upto], part[:, :upto]
            wrong = y - p[:upto]
            step = RATE / (np.bincount(own, minlength=len(w[0])) + DAMP)
            for i in range(3):
                w[i] += (step * np.bincount(own, weights=wrong * part[i], minlength=len(w[0]))).astype(np.float32)
            cell *= 2
            cell += y
            seen = np.bincount(cell, minlength=2 * len(n_map)).reshape(-1, 2)
            n_map += seen.sum(axis=1)
            ones_map += seen[:, 1]
        return out


def _cell(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(2 * z), -(STEPS // 2), STEPS // 2).astype(np.int32) + np.int32(STEPS // 2)


def token_counts(texts: DataFrame) -> DataFrame:
    """token (the empty string is the end), c: occurrences in column `text`."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("token").aggregate([("c", "sum")]).select(["token", "c_sum"]).rename_columns(["token", "c"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for begin, end in text_blocks(texts, TOKEN_CHARS):
                found = Words(texts[begin:end]).strings().value_counts()
                ends = pa.table({"token": [""], "c": [end - begin]})
                held += [pa.table({"token": found.field("values"), "c": found.field("counts")}), ends]
                rows += len(found) + 1
                if rows > 1_000_000:  # bounds the task's memory; the sums meet in the shuffle
                    held = [summed()]
                    if (rows := len(held[0])) > 300_000:
                        yield from held[0].to_batches(50_000)
                        held, rows = [], 0
        if held:
            yield from summed().to_batches(50_000)

    return texts.select("text").mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Trained:
    model: Model
    counts: DataFrame     # of all training tokens
    train_tokens: int
    distinct: int
    least: int            # counts from which a token is in the head


def _binary_rows(part: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(blobs, pa.binary())], ["part", "counts"])


def _spelling(rare: DataFrame) -> np.ndarray:
    """How often each byte, and the end of a spelling, is written for tokens outside the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257)
        for b in batches:
            words, c = b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            size = np.fromiter(map(len, words), np.int64, len(words))
            total[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), weights=np.repeat(c, size), minlength=256)
            total[256] += c.sum()
        yield _binary_rows([0], [total.astype(np.int64).tobytes()])

    rows = added_up(rare.select("token", "c").mapInArrow(run, "part long, counts binary")).collect()
    return np.frombuffer(rows[0]["counts"], np.int64) if rows else np.zeros(257, np.int64)


def train(docs: DataFrame) -> Trained:
    """Learn from all rows of column text."""
    spark = docs.sparkSession
    counts = written(token_counts(docs), "token-counts")
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    # the smallest count that no more than HEAD tokens reach: one row per different count
    histogram = counts.where("c > 1").groupBy("c").count().orderBy(F.desc("c"))
    least, reached = 1 << 62, 0
    for row in histogram.toLocalIterator():
        reached += row["count"]
        if reached > HEAD:
            break
        least = row["c"]
    # at most HEAD rows
    chosen = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "token").select("token", "c").toArrow()
    head = list(zip(chosen["token"].cast(pa.binary()).to_pylist(), chosen["c"].to_pylist()))
    spelled = _spelling(counts.where(F.col("c") < least))
    code = Code.build(head, int(spelled[256]), spelled)
    shared = spark.sparkContext.broadcast(code)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, slots = shared.value, shared.value.slots()
        index, total, n = code.index(), np.zeros(2 * slots, np.int64), np.zeros(len(code.path_at) - 1, np.int64)
        packed, met = np.zeros(slots, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for begin, end in text_blocks(texts, COUNT_CHARS):
                s = Symbols(code, index, texts[begin:end], windows=False)
                if (met := met + len(s.node)) >= 1 << 30:  # before a half is full
                    unpack(packed, total)
                    packed[:], met = 0, len(s.node)
                s.tally_contexts(packed)
                np.add.at(n, s.symbol, 1)
        unpack(packed, total)
        code.tally(n, total)
        blobs = list(as_blobs(total, BLOB))
        for a in range(0, len(blobs), 16):
            yield _binary_rows([p for p, _ in blobs[a:a + 16]], [c for _, c in blobs[a:a + 16]])

    def gathered(partials: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for row in added_up(partials).toLocalIterator():
            values = np.frombuffer(row["counts"], np.int64)
            out[row["part"] * BLOB:][:len(values)] = values
        return out

    # fixed size: sixteen bytes for each slot of the tables
    summed = gathered(docs.select("text").mapInArrow(tally, "part long, counts binary"), 2 * code.slots()).reshape(-1, 2)
    even = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
    model = Model(code, encoded(summed), np.full((GATES, 3), 0.35), even)
    known = spark.sparkContext.broadcast(summed.astype(np.int32) if summed.max(initial=0) < 1 << 31 else summed)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, counts = shared.value, known.value  # a text's own counts are taken out and put back
        index, total = code.index(), np.zeros(GATES * LEVELS**3 * 2, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for begin, end in text_blocks(texts, COUNT_CHARS):
                s = Symbols(code, index, texts[begin:end], windows=False)
                tally_left_out(s, counts, total)
        blobs = list(as_blobs(total, BLOB))
        for a in range(0, len(blobs), 16):
            yield _binary_rows([p for p, _ in blobs[a:a + 16]], [c for _, c in blobs[a:a + 16]])

    # fixed size too: the cells of all gates
    model.fit(gathered(docs.select("text").mapInArrow(inputs, "part long, counts binary"), GATES * LEVELS**3 * 2))
    known.unpersist()
    return Trained(model, counts, n or 0, v or 0, least)


def scored(docs: DataFrame, trained: Trained, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(trained.model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out.alias("held_out"), "text")
    schema = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, "
              "n_bytes long, rare array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = model.code.index()
        for b in batches:
            texts = b.column(3).to_pylist()
            for begin, end in text_blocks(texts, BLOCK_CHARS):
                m = end - begin
                # long texts first: those that have a further window lead every window
                order = sorted(range(begin, end), key=lambda k: -len(texts[k] or ""))
                part = b.take(pa.array(order))
                s = Symbols(model.code, index, [texts[k] for k in order])
                known = s.ids >= 0
                owner = s.doc_of_token[known]
                logs = np.bincount(owner, weights=model.code.log_counts[s.ids[known]], minlength=m).astype(np.float64)
                per_doc = np.bincount(s.doc_of_token[~known], minlength=m)
                rare = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)), s.outside_strings())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(3)], pa.array(s.n_tokens), pa.array(np.bincount(owner, minlength=m)),
                     pa.array(logs), pa.array(model.score(s, m) / math.log(10)), pa.array(s.n_bytes), rare],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "rare"])

    own = written(rows.mapInArrow(run, schema), "scored")
    # tokens outside the head, by their exact counts; a token unknown to training adds log10(0 + 1)
    rare = own.select("row", F.explode("rare").alias("token")).join(trained.counts.where(F.col("c") < trained.least), "token")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_logs"), F.count("*").alias("rare_known"))
    out = own.drop("rare").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    total = math.log10(trained.train_tokens + trained.distinct + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(trained.train_tokens).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))

"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

Every segmentation of a text into vocabulary pieces has a weight, the product of its pieces' weights.
Forward filtering sums the weights of all segmentations of each prefix; backward sampling draws the
last piece by its share of that sum, then the piece before it, and so on: an exact sample. The draws
are a hash of (seed, row key, position), so a row is segmented alike on any cluster and in any batch.

The vocabulary is that of a SentencePiece model file, which is read and never trained. A BPE file
scores pieces by merge rank; a piece of rank r weighs (r + 1)^-theta (Zipf). Characters without a
piece fall back to byte pieces. No piece holds a space mark after another character, so the lattice
falls apart at words: a run of space marks with the characters up to the next one is a unit, and
equal units of a batch are filtered once. Work inside a batch is array work over all units at a time; only
a unit of more than `LONG` characters without a blank is walked alone, as its levels hold one node each.

Decoding is lossless for every text: blanks are space marks, a literal space mark is written in
bytes, and the one leading space mark that encoding adds is taken off again.

Cases: null encodes to null, an empty text to no pieces; a null row key draws as key 0 of its own
stream; repeated rows with equal keys are segmented alike; extra columns pass through `encoded`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wattlink.llm.common import POWERS, mix64, prefix_hash, span_hash, text_blocks

MARK, LITERAL = 0x2581, 0x110000  # the space mark, and the stand-in for one that the text itself holds
BLOCK_CHARS = 1_000_000
LONG = 2048          # characters of a unit that is walked node by node instead of with all others, level by level
WALKED = 1 << 14     # nodes whose edges are taken out of the arrays at once
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Vocabulary:
    """Arrays of a piece vocabulary, as large as the vocabulary itself."""

    hashes: np.ndarray     # of the pieces, sorted
    ids: np.ndarray        # their ids in that order
    log_weight: np.ndarray
    longest: int
    byte_ids: np.ndarray   # id of each byte piece
    byte_log_weight: float
    spelled: np.ndarray    # bytes of all ids, one after another
    spelled_at: np.ndarray
    bucket: np.ndarray     # by the top 20 bits of a hash: place of the first such piece, or -1
    crowd: int             # pieces in the fullest bucket

    @classmethod
    def load(cls, model: str = DEFAULT_MODEL, theta: float = 0.5) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        every = range(sp.vocab_size())
        own = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        own.sort(key=lambda i: (-sp.get_score(i), i))
        byte_ids = np.zeros(256, np.int32)
        spelled = [b""] * len(every)
        for i in every:
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                byte_ids[value], spelled[i] = i, bytes([value])
        if len(set(byte_ids.tolist())) < 256:
            raise ValueError("the model has no byte pieces")
        hashes = []
        for i in own:
            piece = sp.id_to_piece(i)
            if chr(MARK) in piece.lstrip(chr(MARK)):
                raise ValueError(f"piece {piece!r} holds a space mark after another character")
            spelled[i] = piece.replace(chr(MARK), " ").encode()
            v = _values(np.array([ord(c) for c in piece], np.uint32))
            hashes.append(span_hash(prefix_hash(v), np.array([0]), np.array([len(v)]))[0])
        hashes = np.array(hashes, np.uint64)
        order = np.argsort(hashes)
        top = (hashes[order] >> np.uint64(44)).astype(np.int64)
        bucket = np.full(1 << 20, -1, np.int32)
        bucket[top[::-1]] = np.arange(len(top), dtype=np.int32)[::-1]
        return cls(
            hashes[order], np.array(own, np.int32)[order], -theta * np.log(np.arange(1, len(own) + 1))[order],
            max(len(sp.id_to_piece(i)) for i in own), byte_ids, -theta * float(np.log(len(own) + 1)),
            np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelled])]),
            bucket, int(np.bincount(top).max(initial=0)),
        )

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their places."""
        place = self.bucket[h >> np.uint64(44)]
        some = np.flatnonzero(place >= 0)
        place, h, last = place[some], h[some], len(self.hashes) - 1
        for _ in range(self.crowd - 1):
            miss = np.flatnonzero(self.hashes[place] < h)
            if not len(miss):
                break
            place[miss] = np.minimum(place[miss] + 1, last)
        known = self.hashes[place] == h
        return some[known], place[known]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of pieces, with the leading space mark still on."""
        size = self.spelled_at[ids + 1] - self.spelled_at[ids]
        shift = np.repeat(self.spelled_at[ids] - (np.cumsum(size) - size), size)
        return self.spelled[shift + np.arange(len(shift))].tobytes()


def decode(vocabulary: Vocabulary, ids) -> str | None:
    if ids is None:
        return None
    return vocabulary.decode(np.asarray(ids, np.int64))[1:].decode("utf-8", "surrogatepass") if len(ids) else ""


def draws(key: np.ndarray, unit: np.ndarray, step: int | np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for (row key, unit of the row, piece from the unit's end)."""
    x = mix64(key + np.uint64(seed & (2**64 - 1)) * np.uint64(0xD1B54A32D192ED03))
    x = mix64(x ^ (unit.astype(np.uint64) * np.uint64(0xABC98388FB8FAC03) + np.asarray(step, np.uint64)))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """Nodes and edges of distinct units, and the chance of each edge given the node it ends in."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.vocabulary = v
        size, begin = size.astype(np.int32), begin.astype(np.int32)
        first = (np.cumsum(size) - size).astype(np.int32)
        shift = np.repeat(begin - first, size)
        own = codes[shift + np.arange(len(shift), dtype=np.int32)]
        unit = np.repeat(np.arange(len(size), dtype=np.int32), size)
        left = np.repeat(first + size, size) - np.arange(len(own), dtype=np.int32)  # characters up to the unit's end
        self.root = first + np.arange(len(size), dtype=np.int32)                     # a unit has one node more than characters
        self.leaf = self.root + size
        prefix = prefix_hash(_values(own))
        _, down = POWERS.upto(len(prefix))
        starts, lengths, pieces, weights = [], [], [], []
        for n in range(1, min(v.longest, int(size.max(initial=0))) + 1):
            at = np.flatnonzero(left >= n).astype(np.int32)
            hit, place = v.find(mix64((prefix[at + n] - prefix[at]) * down[at]))
            hit = at[hit]
            starts.append(hit), pieces.append(v.ids[place]), weights.append(v.log_weight[place])
            lengths.append(np.full(len(hit), n, np.int32))
            if n == 1:  # characters without a piece: one edge that stands for their bytes
                lone = np.ones(len(own), bool)
                lone[hit] = False
                bare = np.flatnonzero(lone).astype(np.int32)
                c = np.where(own[bare] == LITERAL, MARK, own[bare]).astype(np.int64)
                n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                starts.append(bare), pieces.append((-1 - c).astype(np.int32)), weights.append(n_bytes * v.byte_log_weight)
                lengths.append(np.ones(len(bare), np.int32))
        none = np.zeros(0, np.int32)
        start, length = np.concatenate([none, *starts]), np.concatenate([none, *lengths])
        piece, weight = np.concatenate([none, *pieces]), np.concatenate([np.zeros(0), *weights])
        node = start + unit[start]
        end = node + length
        level = size[unit[start]] - left[start] + length
        order = np.argsort(end, kind="stable")
        self.start, self.piece, end, weight = node[order], piece[order], end[order], weight[order]
        n_nodes = len(own) + len(size)
        into = np.bincount(end, minlength=n_nodes)
        self.first = (np.cumsum(into) - into).astype(np.int32)       # first edge into each node
        self.long = np.flatnonzero(size > LONG)
        alone = size[unit[start]][order] > LONG
        self.upto = np.zeros(len(end), np.float32)
        some = np.flatnonzero(~alone)
        self.upto[some] = self._filter(n_nodes, end[some], weight[some], level[order][some], self.start[some])
        for k in self.long.tolist():
            self._walk(int(self.root[k]), int(self.leaf[k]), weight)

    def _walk(self, root: int, leaf: int, weight: np.ndarray) -> None:
        """Forward filtering of one long unit."""
        alpha = [0.0]  # of the unit's nodes
        exp, log = math.exp, math.log
        for a in range(root + 1, leaf + 1, WALKED):
            b = min(a + WALKED, leaf + 1)
            first = self.first[a:b].tolist()
            e0, e1 = first[0], int(self.first[b]) if b < len(self.first) else len(weight)
            starts, weights, upto = (self.start[e0:e1] - root).tolist(), weight[e0:e1].tolist(), []
            for x, y in zip(first, [*first[1:], e1]):
                if y - x == 1:
                    alpha.append(alpha[starts[x - e0]] + weights[x - e0])
                    upto.append(2.0)
                    continue
                values = [alpha[starts[k]] + weights[k] for k in range(x - e0, y - e0)]
                top = max(values)
                values = [exp(v - top) for v in values]
                total, summed = sum(values), 0.0
                alpha.append(top + log(total))
                for v in values[:-1]:
                    summed += v / total
                    upto.append(summed)
                upto.append(2.0)  # the last edge takes what is left
            self.upto[e0:e1] = upto

    def _filter(self, n_nodes: int, end: np.ndarray, weight: np.ndarray, level: np.ndarray, start: np.ndarray) -> np.ndarray:
        alpha = np.zeros(n_nodes)
        chance = np.zeros(len(end), np.float32)
        if level.max(initial=0) < 1 << 16:
            level = level.astype(np.uint16)
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange(1, int(level.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = by_level[a:b]
            to = end[e]
            runs = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            width = np.diff(np.append(runs, len(e)))
            value = alpha[start[e]] + weight[e]
            top = np.maximum.reduceat(value, runs)
            value = np.exp(value - np.repeat(top, width))
            total = np.add.reduceat(value, runs)
            alpha[to[runs]] = top + np.log(total)
            value /= np.repeat(total, width)
            summed = np.cumsum(value)
            summed -= np.repeat(summed[runs] - value[runs], width)
            summed[runs + width - 1] = 2.0  # the last edge takes what is left
            chance[e] = summed
        return chance

    def sample(self, unit: np.ndarray, key: np.ndarray, number: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each occurrence of a unit, in order, and how many. Negative: a character in bytes."""
        node, root = self.leaf[unit], self.root[unit]
        alone = np.isin(unit, self.long)
        active, step = np.flatnonzero(~alone), 0
        node = node[active]
        who, what = [], []
        while len(active):
            u = draws(key[active], number[active], step, seed)
            edge = self.first[node]
            open_ = np.flatnonzero(u >= self.upto[edge])
            while len(open_):
                edge[open_] += 1
                open_ = open_[u[open_] >= self.upto[edge[open_]]]
            who.append(active), what.append(self.piece[edge])
            node = self.start[edge]
            more = node != root[active]
            active, node, step = active[more], node[more], step + 1
        count = np.zeros(len(unit), np.int64)
        for w in who:
            count[w] += 1
        walks = {int(k): self._walk_back(int(unit[k]), key[k:k + 1], number[k:k + 1], seed) for k in np.flatnonzero(alone)}
        for k, pieces in walks.items():
            count[k] = len(pieces)
        last = np.cumsum(count) - 1
        out = np.zeros(int(count.sum()), np.int64)
        for k, (w, p) in enumerate(zip(who, what)):
            out[last[w] - k] = p
        for k, pieces in walks.items():
            out[last[k] + 1 - len(pieces):last[k] + 1] = pieces
        return out, count

    def _walk_back(self, unit: int, key: np.ndarray, number: np.ndarray, seed: int) -> np.ndarray:
        """Pieces of one occurrence of a long unit, by the same draws and shares as those of all others."""
        root, at = int(self.root[unit]), int(self.leaf[unit])
        edges, u, step = [], [], 0
        while at != root:
            if step == len(u):
                u += draws(key, number, np.arange(step, step + WALKED), seed).tolist()
            edge = int(self.first[at])
            while u[step] >= self.upto[edge]:
                edge += 1
            edges.append(edge)
            at, step = int(self.start[edge]), step + 1
        return self.piece[np.array(edges[::-1], np.int64)]


def _split(text: str, most: int) -> list[str]:
    """Cut a long text where a unit begins, into parts of about `most` characters."""
    parts, at = [], 0
    while len(text) - at > most:
        cut = at + most
        while (cut := text.find(" ", cut)) > 0 and text[cut - 1] == " ":
            cut += 1
        if cut <= 0:
            break
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def encode_block(v: Vocabulary, texts: list[str], keys: np.ndarray, first_unit: np.ndarray, lead: np.ndarray, seed: int):
    """Ids of all texts in one run, ids per text, units per text. lead: whether a space mark goes ahead."""
    raw = [((" " if p else "") + t).encode("utf-32-le", "surrogatepass") for t, p in zip(texts, lead.tolist())]
    codes = np.frombuffer(b"".join(raw), np.uint32).copy()
    sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    # only blanks of the text, not marks it holds, separate units
    codes[codes == MARK] = LITERAL
    codes[codes == 0x20] = MARK
    blank = codes == MARK
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    opens[begins[:-1][sizes > 0]] = True
    begin = np.flatnonzero(opens)
    size = np.diff(np.append(begin, len(codes)))
    text = np.searchsorted(begins, begin, side="right") - 1
    units = np.bincount(text, minlength=len(texts))
    number = np.arange(len(begin)) - np.repeat(np.cumsum(units) - units, units) + first_unit[text]
    h = span_hash(prefix_hash(_values(codes)), begin, begin + size) if len(begin) else np.zeros(0, np.uint64)
    _, where, unit = np.unique(h, return_index=True, return_inverse=True)
    ids, count = Lattice(v, codes, begin[where], size[where]).sample(unit, keys[text], number, seed)
    per_text = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        expanded = [v.byte_ids[np.frombuffer(chr(-1 - c).encode("utf-8", "surrogatepass"), np.uint8)] for c in ids[bare].tolist()]
        width = np.ones(len(ids), np.int64)
        width[bare] = [len(x) for x in expanded]
        owner = np.repeat(np.arange(len(texts)), per_text)
        per_text = np.bincount(owner, weights=width, minlength=len(texts)).astype(np.int64)
        at = np.cumsum(width) - width
        out = np.repeat(ids, width)
        spots = np.repeat(at[bare], width[bare]) + np.concatenate([np.arange(len(x)) for x in expanded])
        out[spots] = np.concatenate(expanded)
        ids = out
    return ids, per_text, units


def encode(v: Vocabulary, texts: list, keys: np.ndarray, seed: int = 0, most: int = BLOCK_CHARS):
    """Ids of each text (None for null), and whether decoding them gives the text back."""
    parts, owner, lead = [], [], []
    for i, t in enumerate(texts):
        for k, p in enumerate(_split(t, most) if t else []):
            parts.append(p), owner.append(i), lead.append(k == 0)
    owner, lead = np.array(owner, np.int64), np.array(lead, bool)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    units_before = np.zeros(len(texts), np.int64)
    same = np.ones(len(texts), bool)

    def run(a: int, b: int) -> None:
        who = owner[a:b]
        ids, per_text, units = encode_block(v, parts[a:b], keys[who], units_before[who], lead[a:b], seed)
        np.add.at(units_before, who, units)
        whole = b"".join((b" " if p else b"") + t.encode("utf-8", "surrogatepass") for t, p in zip(parts[a:b], lead[a:b].tolist()))
        equal = v.decode(ids) == whole
        at = np.concatenate([[0], np.cumsum(per_text)])
        for k in range(b - a):
            own = ids[at[k]:at[k + 1]]
            found[who[k]].append(own)
            if not equal:
                given = (b" " if lead[a + k] else b"") + parts[a + k].encode("utf-8", "surrogatepass")
                same[who[k]] &= v.decode(own) == given

    for a, b in text_blocks(parts, most):
        # parts of one text draw one after another, as each needs the number of units before it
        cuts = [a, *[k for k in range(a + 1, b) if owner[k] == owner[k - 1]], b]
        for x, y in zip(cuts[:-1], cuts[1:]):
            run(x, y)
    empty = np.zeros(0, np.int64)
    return [None if t is None else (np.concatenate(f) if f else empty) for t, f in zip(texts, found)], same


def encoded(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """The columns of `docs` but text, and pieces (array of ids), n_pieces, lossless."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    keys = F.coalesce(F.xxhash64(key), F.lit(0)) if key in docs.columns else F.lit(0).cast("long")
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text", keys.alias("key"))
    schema = packed.select("row").schema.add("pieces", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("lossless", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            ids, same = encode(shared.value, b.column(1).to_pylist(), key, seed)
            offsets = np.concatenate([[0], np.cumsum([0 if i is None else len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *[i for i in ids if i is not None]]).astype(np.int32)
            null = pa.array([i is None for i in ids], pa.bool_())
            pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=null)
            sizes = pa.array([None if i is None else len(i) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pieces, sizes, pa.array(same)], ["row", "pieces", "n_pieces", "lossless"])

    out = packed.mapInArrow(run, schema)
    added = [c for c in ("pieces", "n_pieces", "lossless")]
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "text" and c not in added]
    return out.select(*kept, *added)

"""Runs of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
max(6, 4 q) words long, that no neighbouring word extends keeping period q.

Suffixes of a text are put in order by prefix doubling and the common prefixes of neighbours (LCP) counted.
Neighbours are then united by decreasing LCP (Kruskal) with union-find over ordered sets of
positions, the smaller set into the larger. Two positions i < j that become neighbours inside a set at
LCP l have no position between them that shares l words with them. If j - i is at most l, the l + j - i
words from i on have j - i as smallest period, and they cannot be extended to the right: they seed a run.
The seed whose left neighbour breaks the period is the whole run, so every run is found once. A run with period q
is seeded at an LCP of its length less q, five or more, so positions that share fewer than five
words with any other need not be united.

Texts of a batch are worked on together: no word of one text equals one of another, and a mark of its own
stands between them. Equality of words is exact. Work per text is n log n, and a worker holds the texts of
one block (`BLOCK_CHARS`) or one longer text.

Cases: null and empty texts have no words and no runs; repeated rows have equal results; columns other than
the text pass through, and added columns (`runs`, `strongest`, `collapsed`) replace those of the same name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wattlink.llm.common import text_blocks

LEAST_WORDS, LEAST_PERIODS = 6, 4
SHARED = 5  # words that the seed of any run shares with the position a period on
BLOCK_CHARS = 1_000_000
RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def ordered_suffixes(labels: np.ndarray) -> np.ndarray:
    """Positions that share four or more labels with another one, in the order of their suffixes. Labels
    are below the number of positions, and the first and last one occur once."""
    n = len(labels)
    counts = np.bincount(labels, minlength=n)
    rank = (np.cumsum(counts) - counts)[labels]  # place of the first suffix of the same beginning
    active = np.flatnonzero(counts[labels] > 1)
    wide, width = active[:0], 1
    while len(active):
        key = rank[active] * n + rank[active + width]
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        old = rank[active]
        place = np.arange(len(active))
        opens = np.concatenate([[True], old[1:] != old[:-1]])
        splits = np.concatenate([[True], key[1:] != key[:-1]])
        place = old + place - np.maximum.accumulate(np.where(opens, place, 0))
        rank[active] = place[np.maximum.accumulate(np.where(splits, np.arange(len(active)), 0))]
        alone = splits & np.concatenate([splits[1:], [True]])
        active = active[~alone]
        width *= 2
        if width == 4:
            wide = active
    return wide[np.argsort(rank[wide])]


def shared_prefixes(labels: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """LCP of each of the ordered suffixes with the one before it; 0 for the first."""
    before = dict(zip(suffixes[1:].tolist(), suffixes[:-1].tolist()))
    words, found = labels.tolist(), {}
    last, size = -2, 0
    for i in np.sort(suffixes).tolist():
        j = before.get(i)
        if j is None:
            last = -2
            continue
        # a position that shares SHARED or more is followed by one whose neighbour is the true one, too
        size = size - 1 if i == last + 1 and size >= SHARED else 0
        while words[i + size] == words[j + size]:
            size += 1
        found[i] = size
        last = i
    return np.fromiter((found.get(i, 0) for i in suffixes.tolist()), np.int64, len(suffixes))


def seeds(suffixes: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Position, distance and LCP of positions that become neighbours at a distance within their LCP."""
    member = [[p] for p in suffixes.tolist()]
    parent = list(range(len(member)))
    follower: dict[int, int] = {}
    out, fresh, level = [], [], 0

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def settle() -> None:
        # sets of one LCP are complete: what another position has come between is no neighbour
        out.extend((i, j - i, level) for i, j in set(fresh) if follower[i] == j)
        fresh.clear()

    joins = np.flatnonzero(lcp >= SHARED)
    joins = joins[np.argsort(-lcp[joins], kind="stable")]
    for at, size in zip(joins.tolist(), lcp[joins].tolist()):
        if size != level:
            settle()
            level = size
        a, b = find(at - 1), find(at)
        if len(member[a]) < len(member[b]):
            a, b = b, a
        large, small = member[a], member[b]
        parent[b], member[b] = a, []
        for p in reversed(small):
            k = bisect_left(large, p)
            if k < len(large) and follower.get(p) != large[k]:
                follower[p] = large[k]
                if large[k] - p <= size:
                    fresh.append((p, large[k]))
            if k:
                follower[large[k - 1]] = p
                if p - large[k - 1] <= size:
                    fresh.append((large[k - 1], p))
            large.insert(k, p)
    settle()
    return out


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """start, length, period of all runs of each list of words, by start and period."""
    labels, begin, n = [np.zeros(1, np.int64)], [], 1
    for words in texts:
        begin.append(n)
        last = dict(zip(words, range(n, n + len(words))))  # a word is labelled by its last place
        labels.append(np.fromiter(map(last.__getitem__, words), np.int64, len(words)))
        n += len(words) + 1
        labels.append(np.array([n - 1]))
    flat = np.concatenate(labels)
    suffixes = ordered_suffixes(flat)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(suffixes):
        return found
    met = seeds(suffixes, shared_prefixes(flat, suffixes))
    if not met:
        return found
    start, period, shared = np.array(met, np.int64).T
    length = period + shared
    whole = (flat[start - 1] != flat[start - 1 + period]) & (length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period))
    start, period, length = start[whole], period[whole], length[whole]
    text = np.searchsorted(begin, start, side="right") - 1
    order = np.lexsort((period, start))
    for t, s, size, p in zip(text[order].tolist(), start[order].tolist(), length[order].tolist(), period[order].tolist()):
        found[t].append((s - begin[t], size, p))
    return found


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, then smallest start and period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _struct_array(rows: list, keep_null: bool = False) -> pa.StructArray:
    columns = list(zip(*[r or (0, 0, 0) for r in rows])) or [(), (), ()]
    mask = pa.array([r is None for r in rows], pa.bool_()) if keep_null else None
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], RUN.names, mask=mask)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `docs` and runs (array of start, length, period), strongest (one of them or null) and
    collapsed (the words that stay, joined by one space)."""
    added = {"runs": T.ArrayType(RUN), "strongest": RUN, "collapsed": T.StringType()}
    kept = [c for c in docs.columns if c not in added]
    packed = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("words"))
    schema = packed.select("row").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for begin, end in text_blocks(texts, BLOCK_CHARS):
                # bytes.split() cuts at exactly the six blanks that end a word
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[begin:end]]
                runs = runs_of(words)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), _struct_array([r for own in runs for r in own]))
                best = _struct_array([strongest(r) for r in runs], keep_null=True)
                rest = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), lists, best, rest], ["row", *added])

    return packed.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in kept], *added)

"""Byte-level BPE encoding and decoding.

A text is cut at the file's added tokens and then into pretokens. The symbols of a pretoken, at first
its bytes, form a doubly linked list; a priority queue holds the merge rank and place of every
neighbouring pair that can merge. The lowest rank, leftmost first, merges: its right symbol leaves the
list and the pairs with the new neighbours join the queue. Entries whose pair has changed meanwhile
are stale and skipped. A pretoken of n bytes takes n log n steps, so that one long run of letters is no
hazard. Equal pretokens are merged once for as long as a worker remembers them (`REMEMBERED`).

Decoding concatenates the bytes of the vocabulary strings and reads them as UTF-8, where bytes that are
no UTF-8 become U+FFFD.

The tokenizer file is a parameter (`load`), read on the driver and broadcast; its size does not grow with
the data. Which characters are letters, numbers or blanks is asked of the installed tokenizers library, so
that both sides know the same Unicode version.

Cases: null and empty texts have no ids and decode to an empty text; repeated rows are encoded alike;
the spelling of an added token inside a text becomes that token's id; columns other than the text pass
through, and added columns (`ids`, `decoded`) replace those of the same name.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from wattlink.llm.common import text_blocks

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_CHARS = 500_000
REMEMBERED = 300_000  # pretokens a worker remembers before it starts over
LONG = 4096           # bytes from which a pretoken is not remembered


def _byte_letters() -> list[str]:
    """The character that stands for each byte: visible Latin-1 ones for themselves, the others for
    characters from U+0100 on in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in seen}, 0x100
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def _ranges(codes: list[int]) -> str:
    """The inside of a character class that holds these code points."""
    spans: list[list[int]] = []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def pretoken_patterns() -> list[tuple[int, str]]:
    """The byte-level pretokenizer's pattern with its character classes spelled out, for texts whose
    characters stay below a limit: ASCII, the basic plane, all. Letters and numbers are those of the `regex`
    module that the tokenizers library knows as well."""
    import regex
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)

    def known(kind: str, mark: str) -> list[int]:
        """Code points of a kind that stay in one pretoken with a mark of that kind before them."""
        chars, out = regex.findall(kind, every), []
        for k in range(0, len(chars), 256):
            part = chars[k:k + 256]
            whole = {begin for _, (begin, end) in cut("".join(f"{mark}{c}\n" for c in part)) if end - begin == 2}
            out += [ord(c) for i, c in enumerate(part) if 3 * i in whole]
        return out

    classes = [known(r"\p{L}", "a"), known(r"\p{N}", "1"), list(map(ord, regex.findall(r"\s", every)))]
    out = []
    for limit in (0x80, 0x10000, 0x110000):
        a, n, s = (_ranges([c for c in codes if c < limit]) for codes in classes)
        out.append((limit, f"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+"))
    return out


@dataclass
class Bpe:
    """A byte-level BPE tokenizer file, as large as its vocabulary."""

    patterns: list[tuple[int, str]]
    byte_ids: list[int]                       # symbol of each byte
    merges: list[dict[int, int]]              # by left symbol: right symbol -> rank
    made: list[int]                           # merged symbol of each rank
    spelled: np.ndarray                       # bytes of all vocabulary strings, one after another
    spelled_at: np.ndarray
    added: dict[str, int]                     # tokens that are cut out of a text before all else
    _memory: _Memory | None = field(default=None, repr=False)
    _find: list | None = field(default=None, repr=False)

    @classmethod
    def load(cls, file: str = DEFAULT_FILE) -> Bpe:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                           "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or odd \
                or spec.get("normalizer") or spec.get("post_processor") or not before.get("use_regex", True):
            raise ValueError(f"{file} is not a plain byte-level BPE tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{file} has added tokens that take blanks or word borders with them")
        vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        merges, made = [{} for _ in range(max(vocab.values()) + 1)], []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges[vocab[left]].setdefault(vocab[right], rank)
            made.append(vocab[left + right])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(letters)}
        text_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            inside = all(c in byte_of for c in token)
            text_of[i] = bytes(byte_of[c] for c in token) if inside else token.encode()
        at = np.concatenate([[0], np.cumsum([len(x) for x in text_of])])
        return cls(pretoken_patterns(), [vocab[c] for c in letters], merges, made,
                   np.frombuffer(b"".join(text_of), np.uint8), at, added)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_memory": None, "_find": None}

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges that apply."""
        merges, made, n = self.merges, self.made, len(symbols)
        # an entry is rank * n + place of the left symbol
        queue = [rank * n + i for i, rank in enumerate(
            [merges[a].get(b) for a, b in zip(symbols, symbols[1:])]) if rank is not None]
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = divmod(heappop(queue), n)
            left = symbols[i]
            if left < 0 or (j := after[i]) == n or merges[left].get(symbols[j]) != rank:
                continue  # gone, or another pair stands here now
            left = symbols[i] = made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := merges[left].get(symbols[k])) is not None:
                    heappush(queue, rank * n + i)
            if (h := before[i]) >= 0 and (rank := merges[symbols[h]].get(left)) is not None:
                heappush(queue, rank * n + h)
        return [s for s in symbols if s >= 0]

    def pretokens(self, text: str) -> list[str]:
        if self._find is None:
            self._find = [re.compile(pattern).findall for _, pattern in self.patterns]
        ascii_only, basic, every = self._find
        if text.isascii():
            return ascii_only(text)
        # two bytes a character unless some are beyond the basic plane
        return (basic if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else every)(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self._memory is None or len(self._memory) > REMEMBERED:
            self._memory = _Memory(self)
        find, memory = self.pretokens, self._memory
        numbers: list[np.ndarray] = []
        for text in texts:
            pieces = [text] if not any(t in text for t in self.added) else self._cut(text)
            found = [np.fromiter(map(memory.__getitem__, find(p) if isinstance(p, str) else [p]), np.int64) for p in pieces]
            numbers.append(found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.int64), *found]))
        begin, flat = np.array(memory.begin, np.int64), np.array(memory.flat, np.int32)
        out = []
        for own in numbers:
            size = begin[own + 1] - begin[own]
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[own] - (ends - size), size)
            out.append(flat[at])
        if memory.long:  # very long pretokens would fill the memory by few entries
            self._memory = None
        return out

    def _cut(self, text: str) -> list:
        """Parts between added tokens, and the ids of those tokens."""
        names = sorted(self.added, key=len, reverse=True)
        parts = re.split("(" + "|".join(map(re.escape, names)) + ")", text)
        return [self.added[p] if k % 2 else p for k, p in enumerate(parts) if p]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the vocabulary strings of `ids`."""
        return _spelled(self.spelled, self.spelled_at, ids)


def _spelled(spelled: np.ndarray, spelled_at: np.ndarray, ids: np.ndarray) -> bytes:
    begin = spelled_at[ids]
    size = spelled_at[ids + 1] - begin
    ends = np.cumsum(size)
    return spelled[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)].tobytes()


class _Memory(dict):
    """Number of every pretoken met; ids of number k are flat[begin[k]:begin[k + 1]]. An added token is met
    as its id."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.flat, self.begin, self.long = bpe, array("i"), array("q", [0]), False

    def __missing__(self, token: str | int) -> int:
        if isinstance(token, int):
            ids = [token]
        else:
            data = token.encode("utf-8", "surrogatepass")
            ids = self.bpe.merged(list(map(self.bpe.byte_ids.__getitem__, data)))
            self.long |= len(data) > LONG
        self.flat.extend(ids)
        number = self[token] = len(self.begin) - 1
        self.begin.append(len(self.flat))
        return number


def _ids_array(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _beside(docs: DataFrame, taken: str, added: str, kind: T.DataType) -> tuple[DataFrame, T.StructType, list]:
    """`docs` as (row, taken), the schema of (row, added), and the columns of the result."""
    kept = [c for c in docs.columns if c != added]
    packed = docs.select(F.struct(*kept).alias("row"), F.col(taken).alias("taken"))
    return packed, packed.select("row").schema.add(added, kind), [*[F.col("row").getField(c).alias(c) for c in kept], added]


def encoded(docs: DataFrame, bpe: Bpe, text: str = "text") -> DataFrame:
    """The columns of `docs` and ids, an array of integers."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    packed, schema, columns = _beside(docs, text, "ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for begin, end in text_blocks(texts, BLOCK_CHARS):
                ids = shared.value.encode(texts[begin:end])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), _ids_array(ids)], ["row", "ids"])

    return packed.mapInArrow(run, schema).select(*columns)


def decoded(rows: DataFrame, bpe: Bpe, ids: str = "ids") -> DataFrame:
    """The columns of `rows` and decoded, the text of the ids; null ids decode to an empty text."""
    # decoding workers stand beside the encoding ones: they get the vocabulary strings alone
    shared = rows.sparkSession.sparkContext.broadcast((bpe.spelled, bpe.spelled_at))
    packed, schema, columns = _beside(rows, ids, "decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = np.concatenate([[0], np.cumsum(np.nan_to_num(
                pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))])
            flat = lists.flatten().to_numpy()
            texts = [_spelled(*shared.value, flat[x:y]).decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    return packed.mapInArrow(run, schema).select(*columns)

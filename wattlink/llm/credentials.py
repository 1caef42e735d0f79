"""Secret scans: base patterns, and spans found by automata inferred from labelled credentials.

Labelled credentials are what the base patterns find in all rows. From a bounded number of the
strings of each kind a prefix tree is built, and its states are merged where their outgoing
frequencies agree within Hoeffding bounds (state merging in the red-blue order), which leaves a
probabilistic automaton of the format. A further automaton is inferred from ordinary long tokens of
the same sample. Every run of `SHORTEST` or more credential characters with a letter, in every text, is
scored, with or without a digit; of a run that base spans touch, the parts they leave are. `SHORTEST` is the length
of the shortest labelled credential, so ordinary words are candidates too. A candidate is a secret of kind
`learned` if some format gives it `min_ratio` more nats per character than the ordinary automaton, and `min_gain`
more in all, which asks more per character of a short one. An ordinary token may stand in capitals or begin with one:
such a candidate is compared with its lower-case form as well. Base spans always stay; learned ones never overlap them.

Cases: a null text is empty and has no spans; without `min_strings` labelled credentials of a kind
there is no automaton of it; repeated rows are scanned each; extra columns pass through `redacted`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wattlink.operators.ranking import top_per_key

KINDS = ("assign", "access", "hex", "learned")
_EITHER = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")
) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 6  # characters of a candidate
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")  # the leftmost match begins where the run does
LETTER = re.compile("[A-Za-z]")
_JOINTS = "+/_.=-"
_NAMES = ("password", "passwd", "secret", "token", "api")
_ALPHABET = 66  # credential characters
KNOWN = 1 << 18  # candidates whose verdict a task remembers
STEPS = 1 << 16  # steps of an automaton that a task remembers


@dataclass(frozen=True)
class Fit:
    strings: int = 400          # fitted of each kind, and of ordinary tokens
    longest: int = 256          # longer ones are not fitted, but are scored
    min_strings: int = 20
    alpha: float = 0.05         # confidence of the Hoeffding bound
    min_ratio: float = 0.5      # nats per character over the ordinary automaton
    min_gain: float = 12.0      # nats over it in all: what one ordinary token in 160,000 reaches by chance


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret itself) in order of start, then kind."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # runs of these characters lie within one blank-separated word
    if HEX.search(" ".join([w for w in text.split() if len(w) >= 24])):
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs with a letter, less what base spans take of them; parts that a span cut off lose the joints to it."""
    if not taken:
        return [m.span() for m in RUN.finditer(text) if LETTER.search(m[0])]
    covered: list[list[int]] = []  # apart, in order
    for a, _, e, _ in sorted(taken):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([a, e])
    out, first = [], 0
    for m in RUN.finditer(text):
        begin, end = m.span()
        while first < len(covered) and covered[first][1] <= begin:
            first += 1
        at, k = begin, first
        while at < end:
            a, e = covered[k] if k < len(covered) and covered[k][0] < end else (end, end)
            part = text[at:max(a, at)]
            left = at + (len(part) - len(part.lstrip(_JOINTS)) if at > begin else 0)
            right = at + (len(part.rstrip(_JOINTS)) if a < end else len(part))
            if right - left >= SHORTEST and LETTER.search(text, left, right):
                out.append((left, right))
            at, k = e, k + 1
    return out


class Automaton:
    """A probabilistic automaton merged out of the prefix tree of its strings."""

    def __init__(self, strings: list[str], alpha: float):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.visits, self.ends = [0], [0]
        letters: dict[str, int] = {}
        for s in sorted(strings):
            state = 0
            for c in s:
                letters[c] = letters.get(c, 0) + 1
                self.visits[state] += 1
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({}), self.count.append({}), self.visits.append(0), self.ends.append(0)
                state = self.next[state][c]
            self.visits[state] += 1
            self.ends[state] += 1
        total = sum(letters.values())
        self.letters = {c: (n + 1) / (total + _ALPHABET) for c, n in letters.items()}
        self.unseen = 1 / (total + _ALPHABET)
        self._steps: dict[tuple[int, str], tuple[float, int]] = {}  # log share and next state, once asked
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 and n2 and abs(f1 / n1 - f2 / n2) >= self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n1, n2 = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n1, self.count[b].get(c, 0), n2):
                    return False
            stack += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree of b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if a == b:
                continue
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_all(self) -> None:
        red, settled = [0], {0}
        while True:
            blue = next(((r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in settled), None)
            if blue is None:
                break
            parent, c = blue
            state = self.next[parent][c]
            into = next((r for r in red if self._compatible(r, state)), None)
            if into is None:
                red.append(state)
                settled.add(state)
            else:
                self.next[parent][c] = into
                self._fold(into, state)
        number = {r: i for i, r in enumerate(red)}
        self.next = [{c: number[t] for c, t in self.next[r].items()} for r in red]
        self.count, self.visits, self.ends = ([x[r] for r in red] for x in (self.count, self.visits, self.ends))

    def score(self, s: str) -> float:
        """Log-likelihood of the string; unseen characters are charged the format's letter shares
        and lead back to the start."""
        state, out = 0, 0.0
        for c in s:
            step = self._steps.get((state, c))
            if step is None:
                share = (self.count[state].get(c, 0) + self.letters.get(c, self.unseen)) / (self.visits[state] + 1)
                step = math.log(share), self.next[state].get(c, 0)
                if len(self._steps) < STEPS:
                    self._steps[state, c] = step
            out += step[0]
            state = step[1]
        return out + math.log((self.ends[state] + 0.1) / (self.visits[state] + 1))


class Scanner:
    def __init__(self, formats: list[Automaton], ordinary: Automaton | None, fit: Fit):
        self.formats, self.ordinary, self.fit = formats, ordinary, fit
        self._known: dict[str, bool] = {}  # verdicts of short candidates, which are often ordinary words

    def spans(self, text: str | None) -> list[tuple[int, int, int, int]]:
        text = text or ""
        found = base_spans(text)
        if self.formats:
            found += [(a, 3, b, a) for a, b in candidates(text, found) if self.secret(text[a:b])]
        return sorted(found)

    def secret(self, token: str) -> bool:
        found = self._known.get(token)
        if found is None:
            plain = -len(token) * math.log(_ALPHABET)
            if self.ordinary:
                plain = self.ordinary.score(token)
                if not token.islower() and (token.isupper() or token[1:].islower()):
                    plain = max(plain, self.ordinary.score(token.lower()))
            gain = max(f.score(token) for f in self.formats) - plain
            found = gain >= max(self.fit.min_ratio * len(token), self.fit.min_gain)
            if len(token) <= 64:
                if len(self._known) >= KNOWN:
                    self._known.clear()
                self._known[token] = found
        return found


def _few(strings: set[str], n: int) -> set[str]:
    return set(sorted(strings, key=lambda s: (xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42), s))[:n])


def fitted(docs: DataFrame, fit: Fit = Fit()) -> Scanner:
    """Infer the automata from the labelled strings of all rows, a bounded number of each kind chosen by hash."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set[str]] = {k: set() for k in range(4)}
        seen: set[str] = set()  # bounded; strings looked at before need no second look
        for b in batches:
            for text in b.column(0).to_pylist():
                found = base_spans(text)
                new = [(kind, text[secret:end]) for _, kind, end, secret in found]
                new += [(3, s) for s in {text[a:e] for a, e in candidates(text, found)} - seen]
                seen.update(s for kind, s in new if kind == 3)
                if len(seen) > KNOWN:
                    seen.clear()
                for kind, string in new:
                    if len(string) <= fit.longest:
                        kept[kind].add(string)
                        if len(kept[kind]) > 8 * fit.strings:  # bounds the task's memory and what it sends
                            kept[kind] = _few(kept[kind], fit.strings)
        for kind, strings in kept.items():
            few = sorted(_few(strings, fit.strings))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(few), pa.int64()), pa.array(few, pa.string())], ["kind", "string"])

    labelled = docs.select("text").where("text IS NOT NULL").mapInArrow(label, "kind long, string string").distinct()
    h = F.xxhash64("string")
    unsigned = [(h < 0).asc(), h.asc(), F.col("string").asc()]  # the order of `_few`
    chosen = top_per_key(labelled, ["kind"], unsigned, fit.strings)
    strings: dict[int, list[str]] = {}
    for row in chosen.collect():
        strings.setdefault(row["kind"], []).append(row["string"])
    formats = [Automaton(strings[k], fit.alpha) for k in (0, 1, 2) if len(strings.get(k, [])) >= fit.min_strings]
    ordinary = Automaton(strings[3], fit.alpha) if len(strings.get(3, [])) >= fit.min_strings else None
    return Scanner(formats, ordinary, fit)


def _joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def scan(docs: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned."""
    scanner = docs.sparkSession.sparkContext.broadcast(fitted(docs, fit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scanner.value.spans(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(_joined([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts[:3], pa.array(digest, pa.string()), pa.array(map(_joined, found), pa.string()), counts[3]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")


def redact(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for _, _, end, secret in sorted(spans, key=lambda s: s[3]):
        if end > at:
            if secret >= at:
                out += [text[at:secret], mark]
            at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """`docs` with every secret replaced by a mark, key names kept; n_chars, where there is one, is
    the new length of changed texts."""
    scanner = docs.sparkSession.sparkContext.broadcast(fitted(docs, fit))
    schema = docs.schema
    sized = "n_chars" in docs.columns and schema["n_chars"].dataType.typeName() == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [t if t is None or not (s := scanner.value.spans(t)) else redact(t, s) for t in old]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if sized:
                n = b.schema.get_field_index("n_chars")
                sizes = [c if x is y or x == y else len(y) for c, x, y in zip(b.column(n).to_pylist(), old, new)]
                b = b.set_column(n, b.schema.field(n), pa.array(sizes, pa.int64()))
            yield b

    return docs.mapInArrow(run, schema)

"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit tells the languages with a 1 from those
with a 0 by hashed byte trigrams. The classifiers are log-odds of trigram shares counted over all
training texts, each language weighing alike. A bounded sample of training rows scales each
classifier's margin to log-odds and gives its weight in decoding, one minus twice its error rate.
A text gets the language whose codeword has the least weighted logistic loss against the margins;
the score is that language's share of exp(-loss), and a small lead over the second is ambiguous.

Case of A-Z, digits, punctuation and the kind of blank do not count. Whole texts are read.

Cases: a null text and one without a letter are `und` with score 0, as is every text where nothing
could be learned; languages with fewer than `min_texts` training texts are not learned; repeated rows
are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattlink.llm.common import added_up, as_blobs, text_blocks, thinned

BUCKETS, BLOB = 1 << 16, 1 << 12
BLOCK_BYTES = 1_000_000
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Fit:
    min_texts: int = 5
    sample_rows: int = 2000   # of training rows, to scale and weigh the classifiers
    ambiguous_below: float = 0.2  # lead in loss over the second language


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of a run of texts (a blank stands at both ends), and trigrams per text."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    b = _FOLD[np.frombuffer(b" " + b"  ".join(encoded) + b" ", np.uint8)].astype(np.uint32)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = (key * np.uint32(2654435761)) >> np.uint32(16)
    # the two trigrams that straddle neighbouring texts go
    inside = np.ones(len(bucket), bool)
    ends = np.cumsum(sizes + 2)[:-1] - 2
    inside[ends] = inside[ends + 1] = False
    return bucket[inside], sizes


def codewords(n: int) -> np.ndarray:
    """Rows of -1 and 1, one per language. Up to five languages: the exhaustive code; beyond, the
    widest apart of some seeded dense codes of ten bits per doubling."""
    if n <= 5:
        columns = [[1 if r == 0 or not c >> (r - 1) & 1 else -1 for r in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(columns, np.int8).reshape(-1, n).T
    best, apart = None, -1
    for seed in range(32):
        code = np.where(np.random.default_rng(seed).random((n, int(np.ceil(10 * np.log2(n))))) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min(int((code[i] != code[:i]).sum(axis=1).min()) for i in range(1, n))
        if least > apart:
            best, apart = code, least
    return best


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, fit: Fit):
        self.langs, self.fit = langs, fit
        self.code = codewords(len(langs))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        ones = self.code > 0
        odds = [np.log(share[o].mean(axis=0)) - np.log(share[~o].mean(axis=0)) for o in ones.T]
        self.odds = np.array(odds, np.float32).reshape(-1, BUCKETS).T.copy()
        self.scale, self.weight = np.full(self.code.shape[1], 50.0), np.ones(self.code.shape[1])

    def margins(self, texts: list) -> np.ndarray:
        """Mean log-odds per trigram, by text and bit."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for begin, end in text_blocks(texts, BLOCK_BYTES):
            bucket, n = trigrams(texts[begin:end])
            some = np.flatnonzero(n)
            if len(some) and self.code.shape[1]:
                first = (np.cumsum(n) - n)[some]
                out[begin + some] = np.add.reduceat(self.odds[bucket], first, axis=0, dtype=np.float64) / n[some, None]
        return out

    def calibrate(self, texts: list, langs: list[str]) -> None:
        place = {lang: k for k, lang in enumerate(self.langs)}
        margins, truth = self.margins(texts), self.code[[place[lang] for lang in langs]].astype(float)
        for j in range(self.code.shape[1]):
            m, y, a = margins[:, j], truth[:, j], 1.0
            for _ in range(30):  # Newton steps of a one-parameter logistic regression, lightly damped
                p = 1 / (1 + np.exp(np.clip(y * a * m, -30, 30)))
                step = ((p * y * m).sum() - 1e-3 * a) / ((p * (1 - p) * m * m).sum() + 1e-3)
                a += np.clip(step, -20, 20)
            self.scale[j] = np.clip(a, 1.0, 500.0)
            self.weight[j] = max(0.05, 1 - 2 * float((m * y <= 0).mean()))

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        z = self.margins(texts) * self.scale
        # logistic loss of every codeword bit, weighted and summed by language
        loss = np.stack([(self.weight * np.logaddexp(0, -z * c)).sum(axis=1) for c in self.code], axis=1)
        order = np.sort(loss, axis=1)
        share = np.exp(order[:, :1] - loss)
        score = 1 / share.sum(axis=1)
        lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return [self.langs[k] for k in loss.argmin(axis=1)], score, lead < self.fit.ambiguous_below


def learned(training: DataFrame, fit: Fit = Fit()) -> Model | None:
    """From all rows of text and lang (no nulls). What comes to the driver is one count array per
    language and the bounded sample."""
    # the id, where there is one, keeps copies of one text from being drawn together
    drawn = F.xxhash64(*[c for c in ("doc_id", "text") if c in training.columns])
    training = training.select("text", "lang", drawn.alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().where(F.col("count") >= fit.min_texts).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    place = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            texts, known = b.column(0).to_pylist(), np.array([place.get(x, -1) for x in b.column(1).to_pylist()])
            for begin, end in text_blocks(texts, BLOCK_BYTES):
                bucket, n = trigrams(texts[begin:end])
                owner = np.repeat(known[begin:end], n)
                for k in np.unique(known[begin:end]):
                    if k >= 0:
                        counts[k] += np.bincount(bucket[owner == k], minlength=BUCKETS)
        blobs = list(as_blobs(counts.ravel(), BLOB))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in blobs], pa.int64()), pa.array([c for _, c in blobs], pa.binary())], ["part", "counts"])

    counts = np.zeros(len(langs) * BUCKETS, np.int64)
    for row in added_up(training.select("text", "lang").mapInArrow(count, "part long, counts binary")).collect():
        piece = np.frombuffer(row["counts"], np.int64)
        counts[row["part"] * BLOB:row["part"] * BLOB + len(piece)] = piece
    model = Model(langs, counts.reshape(len(langs), BUCKETS), fit)
    few = thinned(training, sum(sizes.values()), fit.sample_rows, "h")
    rows = [r for r in few.orderBy("h", "lang", "text").limit(fit.sample_rows).collect() if r["lang"] in place]
    model.calibrate([r["text"] for r in rows], [r["lang"] for r in rows])
    return model


def identified(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text", letters.alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, some = b.num_rows, np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
            lang, score, unsure = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            if shared.value is not None and len(some):
                texts = b.column(2).take(pa.array(some)).to_pylist()
                found, score[some], unsure[some] = shared.value.predict(texts)
                for i, x in zip(some.tolist(), found):
                    lang[i] = x
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang), pa.array(score), pa.array(unsure)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")

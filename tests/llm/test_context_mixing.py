import math
import pickle
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlink.llm import context_mixing as M
from wattlink.llm.common import held_out


def by_hand(model, text):
    """Score of one text, decision by decision."""
    code = model.code
    head = {w: k for k, w in enumerate(code.head)}
    symbols = []
    for w in (text or "").encode().lower().split() + [b""]:
        symbols += [head[w]] if w in head else [code.escape, *[code.escape + 1 + c for c in w], code.escape + 257]
    w = {g: model.weights[g].astype(float) for g in range(M.GATES)}
    cells = {c: [M.PRIOR, model.refine[c] * M.PRIOR] for c in range(M.STEPS)}
    total, position, k, u32 = 0.0, 0, 0, 2**32 - 1

    def slot(context, node):
        x = (context ^ (node * 0xD6E8FEB9 & u32)) * 0x85EBCA6B & u32
        x ^= x >> 15
        return (x * 0xC2B2AE35 & u32) >> (32 - M.TABLE_BITS)

    while position < len(symbols):
        size = M.WINDOWS[min(k, len(M.WINDOWS) - 1)]
        seen = []
        for i in range(position, min(position + size, len(symbols))):
            one, two, three, four = ((symbols[i - d] if i >= d else code.escape + 258) for d in (1, 2, 3, 4))
            pair = ((one * 0x9E3779B1 + 1) & u32) ^ (two * 0x85EBCA77 & u32)
            deep = (pair * 0xC2B2AE3D & u32) ^ (three * 0x27D4EB2F & u32) ^ (four * 0x165667B1 & u32)
            near, far = (pair, deep) if symbols[i] > code.escape else (one * 0x9E3779B1 & u32, pair)
            for at in range(code.path_at[symbols[i]], code.path_at[symbols[i] + 1]):
                node, bit = int(code.path_node[at]), int(code.path_bit[at])
                places = [node, slot(near, node) + code.n_nodes, slot(far, node) + code.n_nodes + (1 << M.TABLE_BITS)]
                x = [float(model.counters[p]) for p in places]
                trust = [int(model.counters[p:p + 1].view(np.uint32)[0]) & 3 for p in places]
                g = trust[1] * 4 + trust[2]
                z = sum(a * b for a, b in zip(w[g], x))
                p = 1 / (1 + math.exp(-z))
                c = int(np.clip(np.rint(2 * z), -(M.STEPS // 2), M.STEPS // 2)) + M.STEPS // 2
                final = (p + cells[c][1] / cells[c][0]) / 2
                total += math.log(max(1e-6, final if bit else 1 - final))
                seen.append((g, c, bit, p, x))
        for g in {s[0] for s in seen}:
            own = [s for s in seen if s[0] == g]
            w[g] = w[g] + M.RATE / (len(own) + M.DAMP) * sum((s[2] - s[3]) * np.array(s[4]) for s in own)
        for _, c, bit, _, _ in seen:
            cells[c][0] += 1
            cells[c][1] += bit
        position, k = position + size, k + 1
    return total / math.log(10)


def fixture():
    rng = random.Random(4)
    common = [f"{a}{b}" for a in ("the", "of", "Un", "é") for b in ("", "x", "yz")]
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.8 else f"rare{rng.randrange(400)}" for _ in range(n))
    return [None, "", " \n ", "Unknown WORD ñandú", *[say(rng.choice([3, 30, 200, 900])) for _ in range(260)]]


@pytest.mark.parametrize("head", [1 << 18, 12])
def test_scores_match_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(M, "HEAD", head)
    texts = fixture()
    docs = spark.createDataFrame([(i if i != 2 else None, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    out = held_out(F.col("doc_id"), 7, 2)
    trained = M.train(docs.where(~out))
    got = M.scored(docs, trained, out).collect()
    assert len(got) == len(texts)
    counted: Counter = Counter()
    is_out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in enumerate(texts):
        if i == 2 or not is_out(i):
            counted.update(M.tokens(t))
    n, v = sum(counted.values()), len(counted)
    for r in got:
        i = 2 if r["doc_id"] is None else r["doc_id"]
        words = M.tokens(texts[i])
        assert r["held_out"] == (i != 2 and is_out(i))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counted[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((counted[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
    small = [r for r in got if r["n_tokens"] < 250]
    for r in small[:25]:
        assert math.isclose(r["score"], by_hand(trained.model, texts[2 if r["doc_id"] is None else r["doc_id"]]), rel_tol=2e-4, abs_tol=1e-4)


@pytest.mark.parametrize("n", [1, 10, 300])
def test_every_training_row_is_counted(spark, n):
    """At any size, and repeated rows each."""
    texts = (fixture()[4:] * 2)[:n - 1] + ["the last text"]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    model = M.train(docs).model
    counts = np.zeros(2 * model.code.slots(), np.int64)
    M.Symbols(model.code, model.code.index(), texts).tally(counts)
    assert counts.sum() > 0 and np.array_equal(model.counters.view(np.uint32), M.encoded(counts.reshape(-1, 2)).view(np.uint32))


def test_a_text_is_left_out_of_its_own_fit():
    texts = ["the of thex the", "of of thex", "the ofyz the the"]
    counted: Counter = Counter(w for t in texts for w in M.tokens(t))
    code = M.Code.build(sorted(counted.items(), key=lambda p: (-p[1], p[0])), 0, np.zeros(257, np.int64))
    tally = lambda some: _tallied(code, some)
    for k, t in enumerate(texts):
        s = M.Symbols(code, code.index(), [t])
        others = M.encoded(tally(texts[:k] + texts[k + 1:]))
        want = np.stack([others[slot] for slot in (s.node, s.slot1, s.slot2)])
        assert np.array_equal(M.left_out(s, tally(texts)).view(np.uint32), want.view(np.uint32))


def test_starting_weights_are_fitted_on_every_training_row(spark):
    texts = fixture()[4:] * 2 + ["a text that stands alone"]
    got = M.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).model
    counts, total = _tallied(got.code, texts), np.zeros(M.GATES * M.LEVELS**3 * 2, np.int64)
    for t in texts:
        s = M.Symbols(got.code, got.code.index(), [t])
        M.tally_inputs(M.left_out(s, counts), s.bit, total)
    even = 1 / (1 + np.exp(-(np.arange(M.STEPS) - M.STEPS // 2) / 2))
    want = M.Model(got.code, got.counters, np.full((M.GATES, 3), 0.35), even)
    want.fit(total)
    assert np.allclose(got.weights, want.weights) and np.allclose(got.refine, want.refine)


def _tallied(code, texts):
    total = np.zeros(2 * code.slots(), np.int64)
    M.Symbols(code, code.index(), texts).tally(total)
    return total.reshape(-1, 2)


def test_held_out_rows_cost_less_than_three_bits_a_byte(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = held_out(F.col("doc_id"), 7, 2)
    got = M.scored(docs, M.train(docs.where(~out)), out).where("held_out").agg(F.avg("bits_per_byte")).first()
    assert got[0] < 3.0  # a byte written evenly has 8


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    trained = M.train(docs.limit(0))
    got = M.scored(docs, trained, F.lit(True)).collect()
    assert [r["base_score"] for r in got] == [0.0, 0.0] and all(r["score"] < 0 and r["train_tokens"] == 0 for r in got)
    assert M.scored(docs.limit(0), trained, F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", [np.int32, np.int64])
def test_texts_are_left_out_together(kind):
    """Of several texts at once, each without its own counts, small and large; order of the texts, not of windows."""
    rng = random.Random(6)
    texts = [None, "", *[" ".join(rng.choice(["the", "of", "ofyz", "odd"]) for _ in range(rng.choice([3, 40, 900]))) for _ in range(9)]]
    counted: Counter = Counter(w for t in texts for w in M.tokens(t))
    code = M.Code.build(sorted(counted.items(), key=lambda p: (-p[1], p[0]))[:3], 1, np.ones(257, np.int64))
    counts = _tallied(code, texts).astype(kind)
    before = counts.copy()
    together = M.Symbols(code, code.index(), texts, windows=False)
    got = M.left_out(together, counts)
    assert np.array_equal(counts, before) and before.max() > 2 * M.SMALL
    for k, t in enumerate(texts):
        alone = M.Symbols(code, code.index(), [t], windows=False)
        others = M.encoded(before - _tallied(code, [t]))
        want = np.stack([others[slot] for slot in (alone.node, alone.slot1, alone.slot2)])
        assert np.array_equal(got[:, together.doc == k].view(np.uint32), want.view(np.uint32))


@pytest.mark.parametrize("kind", [np.int32, np.int64])
def test_counts_from_a_broadcast_are_changed_as_fast_as_own_ones(kind):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "of", "ofyz", "odd"]) for _ in range(900)) for _ in range(20)]
    counted: Counter = Counter(w for t in texts for w in M.tokens(t))
    code = M.Code.build(sorted(counted.items(), key=lambda p: (-p[1], p[0]))[:3], 1, np.ones(257, np.int64))
    own, s = _tallied(code, texts).astype(kind), M.Symbols(code, code.index(), texts, windows=False)
    sent = pickle.loads(pickle.dumps(own, 5))

    def seconds(counts):
        begin = time.perf_counter()
        M.left_out(s, counts)
        return time.perf_counter() - begin

    assert M.plain(sent).dtype is np.dtype(kind) and np.shares_memory(M.plain(sent), sent)
    assert np.array_equal(M.left_out(s, sent).view(np.uint32), M.left_out(s, own).view(np.uint32))
    assert min(seconds(sent) for _ in range(5)) < 2.5 * min(seconds(own) for _ in range(5))


@pytest.mark.parametrize("kind", [np.int32, np.int64])
def test_cells_of_the_fit_are_those_of_the_inputs(kind):
    """Counted in one step without the log-odds, the fit meets the same cells; counts small, large and left at zero."""
    rng = random.Random(8)
    texts = [None, *[" ".join(rng.choice(["the", "of", "ofyz", f"odd{rng.randrange(99)}"]) for _ in range(rng.choice([3, 40, 900]))) for _ in range(12)]]
    counted: Counter = Counter(w for t in texts for w in M.tokens(t))
    code = M.Code.build(sorted(counted.items(), key=lambda p: (-p[1], p[0]))[:3], 1, np.ones(257, np.int64))
    counts = _tallied(code, texts).astype(kind)
    before, s = counts.copy(), M.Symbols(code, code.index(), texts, windows=False)
    want, got = np.zeros((2, M.GATES * M.LEVELS**3 * 2), np.int64)
    M.tally_inputs(M.left_out(s, counts), s.bit, want)
    M.tally_left_out(s, counts, got)
    assert np.array_equal(got, want) and np.array_equal(counts, before) and want.sum() == len(s.node)


def test_packed_counts_are_those_of_every_decision():
    """Nodes counted by symbol and contexts in halves of one number, decision by decision the same."""
    texts = ["the of thex the", None, "of of thex rare", "the ofyz the the"]
    code = M.Code.build([(b"the", 5), (b"", 4), (b"of", 3)], 3, np.ones(257, np.int64))
    for windows in (True, False):
        s, want = M.Symbols(code, code.index(), texts, windows=windows), np.zeros(2 * code.slots(), np.int64)
        for slot in (s.node, s.slot1, s.slot2):
            np.add.at(want, slot.astype(np.int64) * 2 + s.bit, 1)
        got = np.zeros_like(want)
        s.tally(got)
        s.tally(got)
        assert np.array_equal(got, 2 * want)
    total = np.zeros(4, np.int64)
    M.unpack(np.array([(7 << 32) + (1 << 31), (1 << 30) << 32]), total)  # a half holds more than 2^31 zeros
    assert total.tolist() == [1 << 31, 7, 0, 1 << 30]


def test_token_counts_of_odd_texts(spark):
    texts = [None, "", " \n\t\x0b ", "A\tb\x0bé x À\r\nZ", "a", *["b é x"] * 7]
    got = {r["token"].encode(): r["c"] for r in M.token_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == Counter(w for t in texts for w in M.tokens(t))
    assert M.token_counts(spark.createDataFrame([], "text string")).count() == 0

import math
from collections import Counter

import numpy as np
import pytest

from wattlink.llm import lattice as L


@pytest.fixture(scope="module")
def vocabulary():
    return L.Vocabulary.load()


@pytest.fixture(scope="module")
def weights():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=L.DEFAULT_MODEL)
    own = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    own.sort(key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): (i, (r + 1) ** -0.5) for r, i in enumerate(own)}


def segmentations(unit, weights):
    """Every segmentation of a unit with its weight."""
    if not unit:
        return [((), 1.0)]
    return [((weights[unit[:n]][0], *rest), weights[unit[:n]][1] * w)
            for n in range(1, min(16, len(unit)) + 1) if unit[:n] in weights for rest, w in segmentations(unit[n:], weights)]


def test_samples_follow_the_exact_distribution(vocabulary, weights):
    exact = segmentations("▁there", weights)
    total = sum(w for _, w in exact)
    n = 20000
    ids, _ = L.encode(vocabulary, ["there"] * n, L.mix64(np.arange(n, dtype=np.uint64)))
    seen = Counter(tuple(i.tolist()) for i in ids)
    assert set(seen) <= {s for s, _ in exact}
    for s, w in exact:
        p = w / total
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p / n) + 1e-3
    assert len(seen) > 5


TEXTS = ["", " ", "a", "  two  blanks ", "tabs\tand\nlines\r\n", "▁ literal ▁▁ marks▁", "Ünïcödé ß 漢字 🙂 \u0000 ￿", "x" * 500,
         "no blank " * 50, None, "漢字" * 300, "tail "]


def test_lossless_and_independent_of_batching(vocabulary):
    keys = np.arange(len(TEXTS), dtype=np.uint64)
    together, same = L.encode(vocabulary, TEXTS, keys)
    assert same.all()
    for i, t in enumerate(TEXTS):
        assert L.decode(vocabulary, together[i]) == t
        alone, _ = L.encode(vocabulary, [t], keys[i:i + 1])
        cut, _ = L.encode(vocabulary, [t], keys[i:i + 1], most=7)
        for other in (alone, cut):
            assert (other[0] is None and t is None) or np.array_equal(other[0], together[i])
    other_seed, _ = L.encode(vocabulary, TEXTS, keys, seed=1)
    assert any(a is not None and not np.array_equal(a, b) for a, b in zip(together, other_seed))


def test_frame(spark, vocabulary):
    docs = spark.createDataFrame([(i if i % 4 else None, t, "p") for i, t in enumerate(TEXTS)], "doc_id long, text string, pieces string")
    one = {str(r["doc_id"]) + str(r["n_pieces"]): r["pieces"] for r in L.encoded(docs.repartition(1), vocabulary).collect()}
    many = {str(r["doc_id"]) + str(r["n_pieces"]): r["pieces"] for r in L.encoded(docs.repartition(5), vocabulary).collect()}
    assert one == many and all(r["lossless"] for r in L.encoded(docs, vocabulary).collect())
    assert L.encoded(docs.limit(0), vocabulary).count() == 0


def test_long_units_are_walked_alike_and_in_time(vocabulary, monkeypatch):
    import random
    import time

    rng = random.Random(4)
    text = "".join(rng.choice("etaoinshrdlu漢é") for _ in range(9000))
    texts, keys = [text, "a b " + text, text, "short"], np.array([1, 1, 2, 3], np.uint64)
    walked, same = L.encode(vocabulary, texts, keys)
    assert same.all() and not np.array_equal(walked[0], walked[2])
    monkeypatch.setattr(L, "WALKED", 100)
    steps, _ = L.encode(vocabulary, texts, keys)
    monkeypatch.setattr(L, "LONG", 1 << 40)
    levels, _ = L.encode(vocabulary, texts, keys)
    for a, b, c in zip(walked, steps, levels):
        assert np.array_equal(a, b) and np.array_equal(a, c)
    monkeypatch.undo()
    million = "".join(rng.choice("abcdefghijklm") for _ in range(1_000_000))
    begin = time.monotonic()
    ids, same = L.encode(vocabulary, [million], keys[:1])
    assert same.all() and L.decode(vocabulary, ids[0]) == million and time.monotonic() - begin < 30

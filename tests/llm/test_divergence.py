import pytest

from wattlink.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, n_words string, `_row` int"


def rows(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "mine", 7) for i, t in enumerate(texts)], SCHEMA)


def by_hand(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    inside = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_base_counts_match_brute_force(spark):
    phrase = "a b c d e f g h i"
    texts = [None, "", " \t\n", phrase, f"{phrase} x {phrase}", "z " * 40, f"{phrase}\n{phrase}\n\n \n", "#1 *$ é% x |",
             " ".join(f"w{i % 13}" for i in range(400)), f"{phrase} y {phrase} q r s t u v w x {phrase}"]
    got = {r["doc_id"]: r for r in D.judge(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in D.COUNTS) == by_hand(t), t


def test_verdicts_guards_and_passed_columns(spark):
    clean = [" ".join(["the cat of a house and", f"word{i}x", "to be in it", f"other{i}", "as is on", f"thing{i}"] * 2) for i in range(80)]
    loud = " ".join(f"SHOUTED{i}!!" for i in range(40))
    docs = rows(spark, [*clean, loud, None, "too short"])
    kept = D.keep_good(docs, D.Limits(most_repeated_percent=101))
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == list(range(80)) and {r["n_words"] for r in kept.collect()} == {"mine"}


@pytest.mark.parametrize("texts", [[], ["a b c"], [None]])
def test_without_references_the_base_rules_decide(spark, texts):
    assert [r["kept"] for r in D.judge(rows(spark, texts, lang=None)).collect()] == [False] * len(texts)

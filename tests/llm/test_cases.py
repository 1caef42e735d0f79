"""Odd input for every operator and stage: nulls in all columns, empty and very long texts, repeated rows,
clashing extra columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wattlink.llm import (
    context_mixing, credentials, decontaminate, divergence, language_id, lattice, simhash, token_counts, url_filter, warc,
)
from wattlink.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside
CLASHING = ("_rank", "_row", "_text", "row", "key", "fp", "h", "n", "count", "sha1", "first", "root", "component_id", "word",
            "kept", "nearest", "n_words", "held_out", "item_id", "value", "rule", "host", "path", "payload", "page", "rank")
PLAIN = "the cat and the dog sat on a mat by the door of the house in town while it was raining hard outside today again"
LONG = " ".join(f"w{k % 977} {k}" for k in range(150_000))
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t", "en", "a", 3), (None, None, None, None, None),
    (None, PLAIN, "en", "a", len(PLAIN)), (4, PLAIN, "en", "a", len(PLAIN)), (4, PLAIN, "en", "a", len(PLAIN)),
    (5, PLAIN + " password: hunter2hunter2", "en", "a", 0), (6, LONG, "en", "b", len(LONG)), (7, "一二三 😀 é " * 30, "zh", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *[F.lit(c).alias(c) for c in CLASHING]).repartition(3).persist()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def op3(docs, spark):
    out = held_out(F.col("doc_id"), 5, 0)
    return language_id.identified(docs, language_id.learned(docs.where(~out), language_id.Fit(min_texts=1)), out)


def op9(docs, spark):
    out = held_out(F.col("doc_id"), 7, 2)
    return context_mixing.scored(docs, context_mixing.train(docs.where(~out)), out)


def pages(docs):
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    return docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"),
                       F.when(F.col("lang").isNotNull(), F.concat(F.lit("http://A.example.net/en/"), "lang")).alias("url"), *rest)


def op1(docs, spark):
    return warc.page_records(spark, warc.write(pages(docs)))


def op2(docs, spark):
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    return url_filter.judge(pages(docs), rules, spark.createDataFrame([(None,), ("a.example.net/en/zh",)], "url string"))


ROW_BY_ROW = {
    "op1": op1, "op2": op2, "op3": op3, "op5": lambda d, s: token_counts.scan(s, token_counts.write(d)),
    "op6": lambda d, s: divergence.judge(d), "op7": lambda d, s: simhash.near_duplicates(d),
    "op8": lambda d, s: lattice.encoded(d, lattice.Vocabulary.load()), "op9": op9, "op10": lambda d, s: credentials.scan(d),
}


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_a_row_for_every_row(spark, odd, none, name):
    assert ROW_BY_ROW[name](none, spark).count() == 0
    got = ROW_BY_ROW[name](odd, spark).collect()
    key = "page_id" if name in ("op1", "op2") else "doc_id"
    order = lambda ids: sorted(ids, key=lambda x: (x is None, x or 0))
    assert order(r[key] for r in got) == order(r[0] for r in ROWS)


def test_items_of_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, PLAIN), (3, PLAIN), (None, "nowhere to be found here")], "item_id long, text string")
    items = items.select("*", F.lit(0).alias("doc_id"), F.lit(0).alias("n_item"))
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.matches(odd, items).collect())
    assert got == [(i, 3) for i in (0, 0, 4, 4, 4, 4, 5, 5)]
    assert decontaminate.matches(none, items).count() == decontaminate.matches(odd, items.where("false")).count() == 0


FILTERING = ("quality", "near_duplicates")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, none, tmp_path, name, stage):
    spark.createDataFrame([(1, None), (2, "unlike any other text of this table")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for docs in (none, odd):
        out = stage(spark, docs, str(tmp_path))
        if name != "pieces":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        if docs is none:
            assert not got
            continue
        if name not in FILTERING:
            assert len(got) == len(ROWS)
        assert all(r[c] == c for r in got for c in CLASHING)
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in got]
            assert ids.count(None) == 2 and len(set(ids)) == len(ids) - 1 and {4, 6, 7} <= set(ids) and not {2, 3} & set(ids)
        if name == "secrets":
            assert [r["text"] for r in got if r["doc_id"] == 5] == [PLAIN + " password: [secret]"]

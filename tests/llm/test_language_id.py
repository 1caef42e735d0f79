import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlink.llm import language_id as L
from wattlink.llm.queries import op3_output_codes

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op3_output_codes(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL AND n_chars >= 200").select("doc_id", "lang")
    right = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = L.codewords(n)
    least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert least >= (1 << n - 2 if n <= 5 else 8) and (np.abs(code.sum(axis=0)) < n).all()


def test_margins_match_a_plain_loop_and_batching():
    rng = np.random.default_rng(0)
    model = L.Model(["a", "b", "c"], rng.integers(0, 9, (3, L.BUCKETS)), L.Fit())
    texts = ["Ein Text, mit 3 Zeichen!", "", None, "é", "ab", "x" * 50]
    for t, m in zip(texts, model.margins(texts)):
        raw = bytes(L._FOLD[np.frombuffer((" " + (t or "") + " ").encode(), np.uint8)])
        keys = [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(raw) - 2)] if t else []
        want = np.mean([model.odds[k] for k in keys], axis=0) if keys else np.zeros(3)
        assert np.allclose(m, want, atol=1e-5)


def test_und_and_nothing_learned(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "12 34!", "en"), (4, "word", None), (None, "x", "en")],
                                 "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = L.learned(docs)
    got = {r["doc_id"]: r for r in L.identified(docs, model, F.lit(False)).collect()}
    assert model is None and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got.values()) and len(got) == 5
    one = L.learned(spark.createDataFrame([("some text", "en")] * 6, "text string, lang string"))
    got = {r["doc_id"]: r["lang_pred"] for r in L.identified(docs, one, F.lit(True)).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", None: "en"}
    assert L.identified(docs.limit(0), one, F.lit(True)).count() == 0


def test_query_learns_languages_of_few_texts(spark, tmp_path):
    rows = [(i, "the cat and the dog sat by the door", "en") for i in range(40)]
    rows += [(i, "der hund und die katze sitzen vor der tuer", "de") for i in (50, 51, 52, 53)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["lang_pred"] for r in op3_output_codes(spark, str(tmp_path)).collect()}
    assert {got[i] for i in (50, 51, 52, 53)} == {"de"} and got[0] == "en"

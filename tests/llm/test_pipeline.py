"""The pipeline's rows on the smallest tables, against SQL for the quality rules and brute force for the rest."""

import duckdb
from test_decontaminate import brute
from test_near_copies import brute as brute_groups

import corpus_pipeline
from wattlink.llm import credentials, lattice
from wattlink.llm.queries import OP6_SQL

DATA = "/root/testdata/sf0.001"


def test_rows_and_texts(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP6_SQL}) WHERE kept").fetchall()}
    docs = [(i, t) for i, t in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if i in good]
    groups, _ = brute_groups(docs)
    docs = sorted(min(g) for g in groups)
    dirty = {m[0] for m in brute(docs, con.execute("SELECT item_id, text FROM benchmark").fetchall())}
    want = {i: t for i, t in docs if i not in dirty}

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert sorted(got) == sorted(want) and 0 < len(got) < len(good)
    vocabulary = lattice.Vocabulary.load()
    for i, r in got.items():
        text, spans = lattice.decode(vocabulary, r["pieces"]), credentials.base_spans(want[i])
        assert r["lossless"] and r["n_pieces"] == len(r["pieces"])
        assert "[secret]" in text if spans else text == want[i] or "[secret]" in text
        assert not [s for s in credentials.base_spans(text) if s[1] > 0]

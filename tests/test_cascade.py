"""Late and partial answers, bad cells, and jobs started from another folder."""

import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattlink import constants as K, schemas
from wattlink.functions import measure as M, text as T
from wattlink.operators import geocode as G, hull, registry as R
from wattlink.streaming import ingest


def rows(spark, n=6):
    empty = {c: "" for c in schemas.STRUCTURED.names}
    data = [tuple((empty | {"企业名称": f"公司{i}", "标准化地址": f"address {i}", "站点名称": f"site {i}", "地区": "r"})[c] for c in schemas.STRUCTURED.names)
            for i in range(n)]
    return spark.createDataFrame(data, schemas.STRUCTURED)


def answer(queries, works):
    body = F.when(F.lit(works), '{"status":"0","msg":"ok","location":{"lon":100,"lat":30,"level":"x"}}').otherwise('{"status":"404"}')
    return queries.select("query", F.lit(200).alias("http_status"), body.alias("body"))


def test_an_unanswered_query_is_pending_and_later_candidates_do_not_count(spark):
    table = rows(spark, 1)
    late = answer(spark.createDataFrame([("rsite 0",)], "query string"), True)
    cache = G.merge_responses(G.cache_frame(spark), late)
    got = G.geocode_resolve(table, cache).first()
    assert (got["地理编码状态"], got["查询地址"], got["经度"]) == ("pending", "address 0", "")
    assert [r["query"] for r in G.geocode_pending(table, cache).collect()] == ["address 0"]


def test_cascade_stops_without_progress_and_goes_on_later(spark):
    table = rows(spark)
    nothing = lambda pending: answer(pending.limit(0), True)
    resolved, cache = G.cascade(table, G.cache_frame(spark), nothing)
    assert {r["地理编码状态"] for r in resolved.collect()} == {"pending"}
    partial = lambda pending: answer(pending.where("query LIKE '%0' OR query LIKE '%1'"), False)
    resolved, cache = G.cascade(table, cache, partial)
    status = {r["企业名称"]: r["地理编码状态"] for r in resolved.collect()}
    assert status["公司0"] == status["公司1"] == "failed" and status["公司2"] == "pending"
    resolved, _ = G.cascade(table, cache, lambda pending: answer(pending, True))
    status = {r["企业名称"]: r["地理编码状态"] for r in resolved.collect()}
    assert status["公司0"] == "failed" and status["公司5"] == "success"


def test_waves_look_only_at_addresses_whose_open_query_failed(spark, monkeypatch):
    table, looked, asked = rows(spark, 20), [], []
    kept = G.looked_up

    def counted(tried, cache):
        looked.append(tried.count())
        return kept(tried, cache)

    cache = {"now": G.merge_responses(G.cache_frame(spark), answer(spark.createDataFrame(
        [("address 3",), ("site 3",), ("rsite 4",)], "query string"), False))}

    def landed(pending):
        # what is asked is what the whole cascade over the whole cache asks
        want = sorted(tuple(r) for r in G.geocode_pending(table, cache["now"]).collect())
        assert sorted(tuple(r) for r in pending.collect()) == want
        asked.append(len(want))
        part = pending.where("query NOT LIKE '%5'")  # never answered
        found = answer(part.where("query LIKE '%7'"), True).unionByName(answer(part.where("query NOT LIKE '%7'"), False))
        cache["now"] = G.merge_responses(cache["now"], found)
        return found

    G.geocode_pending(table, cache["now"])
    start = G.cascade(table.limit(0), G.cache_frame(spark), landed)[0].count()
    monkeypatch.setattr(G, "looked_up", lambda tried, cache: counted(tried, cache) if "_rest" in tried.columns else kept(tried, cache))
    resolved, known = G.cascade(table, cache["now"], landed)
    status = {r["企业名称"]: (r["地理编码状态"], r["查询地址"]) for r in resolved.collect()}
    again = {r["企业名称"]: (r["地理编码状态"], r["查询地址"]) for r in G.geocode_resolve(table, cache["now"]).collect()}
    assert start == 0 and status == again and status["公司5"] == ("pending", "address 5") and status["公司7"][0] == "success"
    per_address = G.geocode_candidates(table, ["企业名称"]).count() // 20
    assert looked[0] == 20 * per_address
    # wave by wave: no address that won or waits, and none of the candidates tried before
    for k, n in enumerate(looked[1:], start=1):
        assert n <= 16 * (per_address - k) + per_address
    assert asked[0] == 20 and max(asked[1:]) <= 19
    assert known.count() == cache["now"].count()


def test_the_latest_of_several_answers_counts(spark):
    given = spark.createDataFrame([("q", 200, '{"status":"1"}', 1), ("q", 200, '{"status":"2"}', 3), ("q", 200, '{"status":"3"}', 2)],
                                  "query string, http_status int, body string, landed_at int")
    assert G.merge_responses(G.cache_frame(spark), given).first()["message"] == "2"


def test_the_stream_asks_pending_rows_again(spark, tmp_path):
    landing, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    cache = {"now": G.cache_frame(spark)}
    enrich = lambda batch: G.geocode_resolve(batch, cache["now"])

    def run():
        ingest.resume_enrichment(spark, landing, sink, state, enrich).awaitTermination()
        return {r["企业名称"]: r["地理编码状态"] for r in spark.read.parquet(sink).collect()}

    table = rows(spark, 4)
    table.where(F.col("企业名称") < "公司2").write.parquet(landing)
    assert run() == {}
    cache["now"] = G.merge_responses(cache["now"], answer(spark.createDataFrame([("address 0",)], "query string"), True))
    table.where(F.col("企业名称") >= "公司2").write.mode("append").parquet(landing)
    assert run() == {"公司0": "success"}
    cache["now"] = G.merge_responses(cache["now"], answer(spark.createDataFrame([(f"address {i}",) for i in range(4)], "query string"), True))
    for _ in range(2):
        ingest.retry_pending(spark, sink, enrich)
        found = [r["企业名称"] for r in spark.read.parquet(sink).collect()]
        assert sorted(found) == [f"公司{i}" for i in range(4)]


@pytest.mark.parametrize("text, value", [("0x" + "F" * 20, float(0xF * (16**20 - 1) // 15)), ("0xff", 255.0), ("0x" + "f" * 300, None), ("0x", None)])
def test_long_hex_text_is_a_number_or_null(spark, text, value):
    assert spark.range(1).select(M.finite_number(F.lit(text))).first()[0] == value


def test_large_whole_numbers_and_ascii_case(spark):
    out = spark.range(1).select(M.format_number(F.lit(1e30)), M.format_number(F.lit(2.5)), T.like_any_case(F.lit("Ａ站"), "ａ"),
                                T.like_any_case(F.lit("xAb%c"), "aB_C")).first()
    assert tuple(out) == ("1" + "0" * 30, "2.5", False, True)


def test_template_slots():
    params = {"a": [{"page": 1}], "Page": {"x": "1"}, "q": {"pageNum": 3, "page": 4}, "t": "{id}"}
    assert R.template_leaves(params)[0] == (("a", 0, "page"), 1) and R.page_slot(params) == ("q", "pageNum")


def test_hot_farm_is_held_in_bounded_form(monkeypatch):
    monkeypatch.setattr(hull, "HOLD", 50)
    rng = random.Random(1)
    points = [(rng.random(), rng.random()) for _ in range(5000)]
    frame = pd.DataFrame({"farm_id": [1] * 5000 + [2] * 3 + [3], "n": 1, "seq": 1, "lng": [p[0] for p in points] + [0, 1, 0, 5],
                          "lat": [p[1] for p in points] + [0, 0, 1, 5]})
    batches = [frame.iloc[a:a + 70] for a in range(0, len(frame), 70)]
    held = []
    real = hull._outer
    monkeypatch.setattr(hull, "_outer", lambda rows: held.append(len(rows)) or real(rows))
    out = pd.concat(list(hull._finish(iter(batches)))).set_index("farm_id")
    assert max(held) < 400 and out["point_count"].tolist() == [5000, 3, 1]
    assert [(v["lng"], v["lat"]) for v in out.loc[1, "boundary"]] == hull.convex_hull(points)


def test_hulls_run_from_an_empty_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1]); from pyspark.sql import SparkSession; import __spark_entry__ as e;"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate();"
            "print('ROWS', e.queries()['farm_hull'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    """Files of earlier batches stay; a replayed batch gives the same sink; keys are looked up in the batch's own folders."""
    sink = str(tmp_path / "out")
    cache = G.merge_responses(G.cache_frame(spark), answer(spark.createDataFrame([(f"address {i}",) for i in range(6)], "query string"), True))
    enrich = lambda batch: G.geocode_resolve(batch, cache)
    table = rows(spark, 8)  # the last two stay pending

    def land(batch, batch_id):
        ingest._land_answered(spark, batch, ingest.waiting_rows(spark, sink, batch_id), sink, batch_id, enrich)

    def state():
        files = {str(f) for f in tmp_path.rglob("*.parquet")}
        found = sorted(r["企业名称"] for r in spark.read.parquet(sink).collect())
        return files, found, sorted(r["企业名称"] for r in ingest.waiting_rows(spark, sink).collect())

    land(table.where("`企业名称` < '公司4' OR `企业名称` = '公司7'"), 0)
    first, found, waiting = state()
    assert found == [f"公司{i}" for i in range(4)] and waiting == ["公司7"]
    land(table, 1)  # four of them again
    second, found, waiting = state()
    assert first < second and found == [f"公司{i}" for i in range(6)] and waiting == ["公司6", "公司7"]
    assert len(second - first) == 2 + 1  # two answers, one new pending row
    land(table, 1)
    assert state()[1:] == (found, waiting)
    plan = ingest._batches_before(spark, sink, 2, G.ROW_KEY, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters", 1)[1].split("]")[0]

import re

import pytest

from wattlink.llm import url_filter as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b.c", "", "block"), ("a.b.c", "/x", "allow"), ("b.c", "/x/yy", "block"),
         ("b.c", "/x/yy", "allow")]
URLS = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/x?y#z", "http://example.net/EN/", "http://sub.example.net/en/", "http://xexample.net/en/",
        "http://net", "http://net/", "http://a.b.c", "http://z.a.b.c/x/yyz", "http://b.c/x/yy", "q://a.b.c?x://y/z", "http://listed.org/p/", "http://listed.org/p?q",
        "http://listed.org/p/q", "http://ÄB.net/ü", "http://.net/", "http://a..net/", "http://listed.org/p"]


def by_hand(url, listed):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[3:] if fits else (None, "block" if host and host + path.rstrip("/") in listed else "allow")
    return host, path, rule, verdict


@pytest.mark.parametrize("most", [64 << 20, 0])
@pytest.mark.parametrize("extra", [0, 3000])
def test_judged_like_plain_rules(spark, monkeypatch, most, extra):
    monkeypatch.setattr(U, "BROADCAST_BYTES", most)
    listed = ["listed.org/p", None, *[f"h{i}.org/{i}" for i in range(extra)]]
    urls = URLS + [f"http://h{i}.org/{i}/?{i}" for i in range(0, 6000, 100)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = U.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([(x,) for x in listed], "url string"))
    rows = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got.collect())
    want = []
    for i, u in enumerate(urls):
        host, path, rule, verdict = by_hand(u, set(listed))
        want += [(i, host, path, rule or "", verdict)] * 2
    assert rows == sorted(want)


def test_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(20000).selectExpr("concat('k', id) AS key")
    blocks, n = U.bloom(keys)
    assert U.possible(keys, blocks, n).count() == 20000
    assert U.possible(spark.range(20000).selectExpr("concat('o', id) AS key"), blocks, n).count() < 400


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    nothing = spark.createDataFrame([], "url string")
    assert U.judge(pages.limit(0), rules, nothing).count() == 0
    assert U.judge(pages, rules.limit(0), nothing).first()["verdict"] == "allow"


def test_keys_of_a_host_with_very_many_labels_stay_linear(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    long = "http://" + "x." * 200_000 + "b.c/x/yy/" + "p" * 100_000
    pages = spark.createDataFrame([(1, long), (2, "http://" + "." * 100_000 + "net/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages, rules, spark.createDataFrame([], "url string")).collect()}
    assert got == {1: ("b.c/x/yy", "block"), 2: ("net/", "block")}

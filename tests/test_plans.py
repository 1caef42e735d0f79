"""Physical plans: what must and must not be in them."""

from pyspark.sql import functions as F

from wattlink.checks import association as C, fixtures, registry as P
from wattlink.operators import association as A, registry as R, views as V
from wattlink.plans import jobs

SF = "/root/testdata/sf0.001"


def plan(df):
    df._jdf.queryExecution().executedPlan()
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_radius_join_plan(spark):
    for strategy in ("broadcast", "shuffle"):
        text = plan(C._links(spark, SF, manual=False, strategy=strategy)[2])
        assert "WindowGroupLimit" in text
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    text = plan(C._links(spark, SF, manual=False, strategy="broadcast")[2])
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_text_join_plan(spark):
    text = plan(C._links(spark, SF, "solar", "poi", manual=False)[2])
    assert "WindowGroupLimit" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_dedupe_reduces_before_the_shuffle(spark):
    rows = fixtures.table(spark, SF, "events").select(
        F.col("event_type").alias("地区"), F.lit(None).cast("string").alias("社会统一信用代码"),
        F.col("event_type").alias("企业名称"), F.col("event_type").alias("发电类型"), F.col("event_type").alias("装机容量"),
        F.col("ts").cast("string").alias("更新时间"))
    text = plan(R.latest_records(rows))
    assert text.count("WindowGroupLimit") >= 2  # partial and final


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "farms")
    fixtures.spark_view(spark, SF, "farms").write.parquet(path)
    farms = spark.read.parquet(path)
    text = plan(farms.where(V.energy_match("solar") & V.province_match("province", "云南")).select("id"))
    assert "PushedFilters" in text and "In(power_type" in text and "StringContains(province,云南)" in text
    assert "raw_address" not in text


def test_energy_partition_is_pruned(spark, tmp_path):
    path = str(tmp_path / "points")
    fixtures.spark_view(spark, SF, "points").write.partitionBy("energy_type").parquet(path)
    text = plan(A.usable_points(spark.read.parquet(path), "wind").select("id", "lng"))
    assert "PartitionFilters" in text and "energy_type" in text.split("PartitionFilters", 1)[1].split("\n")[0]


def test_pages_and_links_are_read_once(spark, tmp_path, monkeypatch):
    """Sources share one pass for their gaps; automatic links are not planned again for the manual ones."""
    scans = []
    write = jobs.stored
    monkeypatch.setattr(jobs, "stored", lambda df, label: scans.append(plan(df).count("Scan parquet")) or write(df, label))
    path = str(tmp_path / "pages")
    P.pages(spark, SF).write.parquet(path)
    sources = [P.SOURCE | {"name": f"S{i}"} for i in range(3)]
    rows = jobs.registry_from_pages(spark.read.parquet(path), sources, now=P.NOW)
    assert scans[0] == 2  # one scan for the gaps, named in the tree and in the list of its nodes
    assert plan(rows).split("== Physical Plan ==")[1].count(f"Location: InMemoryFileIndex [file:{path}]") <= 3
    links = C._links(spark, SF)[2]
    assert "nearest" not in plan(links) and plan(links).count("WindowGroupLimit") == 0


def test_hot_lookup_key_is_split(spark):
    """A key that holds most rows of a lookup's big side is spread over several tasks."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        many = spark.range(0, 400_000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("query"), "id")
        cache = spark.range(0, 400_000, 1, 8).select(F.col("id").cast("string").alias("query"), F.lit("x").alias("lon"))
        out = many.join(cache, "query", "left")
        assert out.groupBy("lon").count().count() == 2
        joined = out.select("id", "lon")
        joined.collect()
        assert "isSkew=true" in joined._jdf.queryExecution().executedPlan().toString() or "skewed" in \
            joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

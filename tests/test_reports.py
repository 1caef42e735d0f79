"""Link lists, counts and the end-to-end preview on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from wattlink.operators import association as A, ranking
from wattlink.plans import jobs


@pytest.fixture(scope="module")
def world(spark):
    farms = spark.createDataFrame(
        [(1, "甲", "风电", "云南省", "102.0", "25.0", "某镇"), (2, "乙", "风电", "浙江省", "102.01", "25.0", ""),
         (3, "丙", "风电", "云南省", "", "", "某镇"), (4, "丁", "水电", "云南省", "102.0", "25.0", "")],
        "id long, enterprise_name string, power_type string, province string, longitude string, latitude string, raw_address string")
    points = spark.createDataFrame(
        [(i, "wind", f"{i}.jpg", "yunnan", "云南省", str(102.0 + i / 1e4), "25.0", "某镇东", 1) for i in range(40)]
        + [(90, "wind", "90.jpg", "yunnan", "云南省", "110", "30", "", 1), (91, "wind", "91.jpg", "x", "浙江省", "", "25", "", 1),
           (92, "solar", "92.jpg", "yunnan", "云南省", "102.0", "25.0", "", 1)],
        "id long, energy_type string, original_image string, province_code string, province_name string, longitude string, "
        "latitude string, poi string, image_exists int")
    manual = spark.createDataFrame(
        [("wind", 2, 90), ("wind", 2, 90), ("wind", 1, 0), ("wind", 3, 5), ("wind", 7, 5), ("solar", 1, 92), ("wind", 2, 3)],
        "energy_type string, farm_id long, recognition_id long")
    return farms, points, manual


def test_preview(world):
    farms, points, manual = world
    p = jobs.association_preview(farms, points, manual, "wind", "radius", 1.0)
    got = {(r["farm_id"], r["recognition_id"], r["association_source"]) for r in p.links.collect()}
    auto = {(1, i, "auto") for i in range(40)}  # 102.0039 is still nearer to 102.0 than to 102.01
    assert got == auto | {(2, 90, "manual"), (2, 3, "manual")}
    assert p.summary.first().asDict() == {
        "farm_count": 2, "linked_farm_count": 2, "recognition_count": 41, "linked_recognition_count": 41, "outlier_count": 0}
    assert {r["id"]: r["associated_count"] for r in p.farms.collect()} == {1: 40, 2: 2}
    assert p.outliers.count() == 0
    assert [r["recognition_id"] for r in p.images.where("farm_id = 1").orderBy("position").collect()] == list(range(39, 31, -1))


def test_documents_in_chunks(world):
    farms, points, manual = world
    p = jobs.association_preview(farms, points, manual, "wind", "radius", 1.0)
    docs = [json.loads(r["json"]) for r in jobs.farm_documents(p).orderBy("farm_id").collect()]
    assert [(d["id"], d["associated_count"], len(d["preview_images"])) for d in docs] == [(1, 40, 8), (2, 2, 2)]
    assert docs[0]["boundary"] == [{"lng": 102.0, "lat": 25.0}, {"lng": 102.0039, "lat": 25.0}]
    lists = [json.loads(r["json"]) for r in jobs.link_documents(p, chunk=15).orderBy("farm_id", "chunk_no").collect()]
    assert [(d["id"], len(d["associated"])) for d in lists] == [(1, 15), (1, 15), (1, 10), (2, 2)]
    ids = [x["recognition_id"] for d in lists[:3] for x in d["associated"]]
    assert ids == list(range(39, -1, -1))
    assert [x["recognition_id"] for x in lists[3]["associated"]] == [90, 3]
    assert lists[3]["associated"][0]["image_url"] == "/api/recognition/image?type=wind&name=90.jpg"
    assert {(r["kind"], r["id"]) for r in p.unlocated.collect()} == {("farm", 3), ("point", 91)}


def test_poi_mode_and_province(world):
    farms, points, _ = world
    p = jobs.association_preview(farms, points, None, "wind", "poi", province="云南")
    assert {r["farm_id"] for r in p.links.collect()} == {1} and p.links.count() == 40
    assert [r["id"] for r in p.outliers.collect()] == [90]
    assert jobs.association_preview(farms, points, None, "wind", "radius", 10.0, province="北京").links.count() == 0


def test_blank_coordinates_as_zero(world):
    farms, points, _ = world
    assert A.usable_farms(farms, "wind").count() == 2
    assert {(r["lng"], r["lat"]) for r in A.usable_farms(farms, "wind", blank_as_zero=True).where("id = 3").collect()} == {(0.0, 0.0)}


def test_numbers_inside_one_hot_group(spark):
    df = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"),
                                             (F.xxhash64("id") % 100_000).alias("v"), "id")
    got = ranking.numbered(df, [F.col("v"), F.col("id")], ["g"], "n").orderBy("g", "n").collect()
    assert [r["n"] for r in got] == list(range(1, 10_001)) + list(range(1, 20_001))
    assert [(r["g"], r["v"], r["id"]) for r in got] == sorted((r["g"], r["v"], r["id"]) for r in got)


def test_union_by_id(spark):
    left = spark.createDataFrame([(1, "l"), (1, "l"), (2, "l")], "id long, s string")
    right = spark.createDataFrame([(2, "r"), (3, "r")], "id long, s string")
    assert sorted(tuple(r) for r in A.union_by_id(left, right).collect()) == [(1, "l"), (2, "l"), (3, "r")]

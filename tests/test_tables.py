"""Imports, files and stored tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wattlink import constants as K, schemas
from wattlink.operators import geocode, imports as I, registry as R
from wattlink.plans import jobs
from wattlink.sources import csvio, images, landed, tables
from wattlink.streaming import ingest

OLD, NOW, LATER = "2025-01-01 00:00:00", "2026-01-01 00:00:00", "2026-02-02 00:00:00"


def write(path, text, bom=True):
    path.write_text(("﻿" if bom else "") + text, encoding="utf-8")
    return str(path)


def farm_file(tmp_path, rows, name="farms.csv"):
    lines = [",".join(K.FARM_IMPORT_COLUMNS)]
    for row in rows:
        lines.append(",".join(row.get(c, "") for c in K.FARM_IMPORT_COLUMNS))
    return write(tmp_path / name, "\n".join(lines) + "\n")


def test_templates_import(spark, tmp_path):
    for kind in ("power-fields", "solar-recognition", "wind-recognition"):
        path = str(tmp_path / kind)
        csvio.write_template(spark, kind, path)
        rows = csvio.read_import_csv(spark, path)
        assert I.validate_import(rows, kind).count() == 1
        assert rows.columns[:-1] == K.IMPORT_TEMPLATES[kind][0]
    part = [f for f in os.listdir(tmp_path / "power-fields") if f.startswith("part")][0]
    assert (tmp_path / "power-fields" / part).read_bytes().startswith('﻿"地区",'.encode())
    with pytest.raises(ValueError):
        csvio.import_template(spark, "other")


def test_export_file_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y", z'), (" b ", None)], "`图` string, `省,市` string").coalesce(1)
    csvio.write_export(rows, str(tmp_path / "export"))
    parts = sorted(f for f in os.listdir(tmp_path / "export") if f.startswith("part"))
    whole = b"".join((tmp_path / "export" / p).read_bytes() for p in parts)
    assert whole.decode() == csvio.BOM + '图,"省,市"\na,"x ""y"", z"\n b ,\n'


def test_first_row_decides_the_format(spark):
    columns = "row_no long, Tile_Name string, Longitude string, Latitude string, Province string, City_County string, POI string"
    rows = [(4, "", "1", "2", "p", "c", ""), (2, "a.jpg", "1", "2", "p", "c", ""), (9, "b.jpg", "", "2", "p", "c", "")]
    with pytest.raises(I.ImportRejected, match="第 4 行缺少必填字段: original_image"):
        I.validate_import(spark.createDataFrame(rows, columns), "solar-recognition")
    with pytest.raises(I.ImportRejected, match="格式不正确"):
        I.validate_import(spark.createDataFrame([(1, *rows[0][1:]), *rows[1:]], columns), "solar-recognition")


def test_import_file_quirks(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n 1 , "x\n"\n\n"2,","say ""hi"""\n')
    rows = [tuple(r) for r in csvio.read_import_csv(spark, path).select("row_no", "a", "b").collect()]
    assert rows[0][:2] == (1, "1") and rows[1] == (2, "2,", 'say "hi"')
    for ragged in ("a,b\n1\n", "a,b\n1,2,3\n"):
        with pytest.raises(Exception):
            csvio.read_import_csv(spark, write(tmp_path / f"{len(ragged)}.csv", ragged)).collect()


def test_several_import_files_follow_by_path(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    write(folder / "a.csv", "v\n" + "".join(f"a{i}\n" for i in range(5)))
    write(folder / "b.csv", "v\n" + "".join(f"b{i}\n" for i in range(3000)))
    rows = csvio.read_import_csv(spark, str(folder)).orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == list(range(1, 3006))
    assert [r["v"] for r in rows] == [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(3000)]


def test_registry_csv(spark, tmp_path):
    assert csvio.read_registry_csv(spark, str(tmp_path / "none.csv")).count() == 0
    path = write(tmp_path / "r.csv", "地区,企业名称,extra\n云南,NA,1\nnull,\"甲,\n乙\",2\n")
    df = csvio.read_registry_csv(spark, path)
    assert df.columns == K.REGISTRY_COLUMNS
    assert [(r[0], r[2], r[5]) for r in df.collect()] == [("云南", None, None), (None, "甲,\n乙", None)]


def test_rejections(spark, tmp_path):
    good = farm_file(tmp_path, [{"企业名称": "甲"}, {"企业名称": ""}, {"企业名称": " "}])
    with pytest.raises(I.ImportRejected, match="第 2 行缺少必填字段: 企业名称"):
        I.validate_import(csvio.read_import_csv(spark, good), "power-fields")
    with pytest.raises(I.ImportRejected, match="缺少字段: 社会统一信用代码"):
        I.check_headers(spark.createDataFrame([("x",)], "`地区` string"), "power-fields")
    empty = spark.createDataFrame([], "Tile_Name string")
    with pytest.raises(I.ImportRejected, match="没有可导入"):
        I.check_headers(empty, "solar-recognition")
    with pytest.raises(I.ImportRejected, match="必要字段"):
        I.check_headers(spark.createDataFrame([("x",)], "Tile_Name string"), "solar-recognition")


def test_header_alias_even_if_blank(spark):
    rows = spark.createDataFrame([("", "b.jpg", "P")], "Tile_Name string, `原始图片` string, POI string")
    got = I.recognition_fields(rows, "solar").first()
    assert got["original_image"] == "" and got["poi"] == "P" and got["city"] == ""


def test_import_twice_equals_once(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = [{"企业名称": n, "装机容量": c, "经纬度可信度": q} for n, c, q in
            (("乙", "1", "0.9"), ("甲", "2", "x"), ("乙", "3", ""))]
    file = csvio.read_import_csv(spark, farm_file(tmp_path, rows))
    jobs.import_file(spark, root, file, "power-fields", NOW)
    first = tables.read_table(spark, root, "power_fields").orderBy("id").collect()
    assert [(r["id"], r["enterprise_name"], r["capacity"], r["confidence"]) for r in first] == [
        (1, "乙", "3", 0.0), (2, "甲", "2", 0.0)]
    jobs.import_file(spark, root, file, "power-fields", LATER)
    again = tables.read_table(spark, root, "power_fields").orderBy("id").collect()
    assert [r.asDict() | {"updated_at": NOW} for r in again] == [r.asDict() for r in first]
    assert {r["updated_at"] for r in again} == {LATER} and {r["created_at"] for r in again} == {NOW}


def test_point_import_partitions_and_evolution(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = spark.createDataFrame([(1, "a.jpg", "1", "2", "YUNNAN", "x")],
                                 "row_no long, original_image string, turbine_lon string, turbine_lat string, province string, city string")
    files = spark.createDataFrame([("a.jpg",)], "name string")
    jobs.import_file(spark, root, rows, "wind-recognition", NOW, files)
    got = tables.read_table(spark, root, "recognition").first()
    assert (got["energy_type"], got["province_name"], got["image_exists"], got["poi"]) == ("wind", "云南省", 1, "")
    old = spark.createDataFrame([(7, "老站")], "id long, enterprise_name string")
    tables.write_table(old, root, "power_fields")
    assert tables.read_table(spark, root, "power_fields").select("id", "capacity", "power_type").first() == (7, None, None)


def test_images(spark, tmp_path):
    for name in ("a.jpg", "sub/a.jpg", "sub/b c+d%20.jpg", ".hidden", "sub/.x.jpg", ".away/c.jpg", "_d.jpg", "_e/deep/er/f.jpg"):
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True, parents=True)
        target.write_bytes(b"" if name == "_d.jpg" else b"1")
    (tmp_path / "sub" / "loop").symlink_to(tmp_path)
    (tmp_path / "sub" / "link.jpg").symlink_to(tmp_path / "a.jpg")
    (tmp_path / "nothing").mkdir()
    names = ["_d.jpg", "a.jpg", "a.jpg", "b c+d%20.jpg", "f.jpg", "link.jpg", "loop"]
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        files = images.list_images(spark, folder)
        assert sorted(r["name"] for r in files.collect()) == names
    best = {r["name"]: r["path"] for r in images.image_names(files).collect()}
    assert best["a.jpg"] == f"file:{tmp_path}/sub/a.jpg"
    assert images.list_images(spark, str(tmp_path / "none")).count() == 0
    landed = spark.createDataFrame([(f"x/{p}",) for p in ("a", "b/a", "a", ".b/c", "b/.c", "d/")] + [(None,)], "path string")
    assert sorted(images.landed_images(landed).collect()) == [("x/a", "a"), ("x/b/a", "a")]


def test_cache_files(spark, tmp_path):
    entries = {"q1": {"status": "success", "lon": "1", "lat": "2", "query": "other"}, "q2": {"status": "failed"}}
    path = write(tmp_path / "c.json", json.dumps(entries, ensure_ascii=False, indent=2), bom=False)
    got = {r["query"]: r["status"] for r in landed.read_cache(spark, path).collect()}
    assert got == {"other": "success", "q2": "failed"}
    assert landed.read_cache(spark, str(tmp_path / "none")).count() == 0
    assert landed.read_cache(spark, write(tmp_path / "bad.json", "{oops", bom=False)).count() == 0


def test_merge_keeps_known_answers(spark):
    cache = spark.createDataFrame([("a", "failed")], "query string, status string")
    responses = spark.createDataFrame([("a", 200, '{"status":"0","location":{"lon":1,"lat":2}}'), ("b", 200, "[]")],
                                      schemas.RESPONSES)
    got = {r["query"]: (r["status"], r["message"]) for r in geocode.merge_responses(cache, responses).collect()}
    assert got == {"a": ("failed", None), "b": ("failed", "unknown")}


def test_manifest_blocks(spark):
    source = {"list_api": {"json_params": {"list": [{"page": 3}], "Page": {"x": 1}, "p": {"pageNum": 1}},
                           "pagination": {"page_size": 10}}}
    assert R.page_number_path(source["list_api"]["json_params"]) == "p.pageNum"
    totals = spark.createDataFrame([("a", 95), ("b", 0)], "source string, total long")
    got = R.request_manifest(totals, source, block=3).orderBy("page").collect()
    assert [r["page"] for r in got] == list(range(1, 11))
    assert json.loads(got[9]["body"])["p"] == {"pageNum": 10}


def test_latest_is_idempotent_and_handles_unreadable_times(spark):
    rows = [("a", None, "2026-3-1 3:06:07"), ("a", None, "2026-03-01 03:06:06"), ("b", None, "2026/3/31 13:36"), ("b", None, None)]
    df = spark.createDataFrame(rows, "`地区` string, `企业名称` string, `更新时间` string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in K.REGISTRY_COLUMNS if c not in df.columns}).select(*K.REGISTRY_COLUMNS)
    once = R.latest_records(df)
    want = {("a", "2026-3-1 3:06:07"), ("b", "2026/3/31 13:36")}
    assert {(r[0], r[5]) for r in once.collect()} == want
    assert {(r[0], r[5]) for r in R.latest_records(once).collect()} == want
    assert {(r[0], r[5]) for r in R.latest_records_by_max(df).select(*K.REGISTRY_COLUMNS).collect()} == want


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """A micro-batch that is run again overwrites its own folder."""
    df = spark.createDataFrame([("a",)], "x string")
    for _ in range(2):
        ingest._write_batch(df, str(tmp_path / "sink"), 0)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 1
    assert ingest._batches_before(spark, str(tmp_path / "sink"), 0, ["x"]).count() == 0


def test_first_gaps(spark):
    full, cut = range(1, 2 * R.BUCKET + 8), [n for n in range(1, R.BUCKET + 50) if n != R.BUCKET]
    pages = {"full": full, "cut": cut, "late": [2, 3], "none": [], "long": [*range(1, 3 * R.BUCKET + 1)], "second": range(R.BUCKET + 1, 2 * R.BUCKET),
             "few": [1, 2, 2, 3, 5], "first": [1], "odd": [0, -1, 1, 2, 4]}
    rows = [(s, n, 3) for s, ns in pages.items() for n in ns] + [("none", 1, 0), ("few", 4, 0), ("none", None, 5), ("odd", 3, None)]
    got = {r["source"]: r["first_gap"] for r in R.first_gaps(spark.createDataFrame(rows, "source string, page long, n_items int")).collect()}
    want = {s: min(set(range(1, 1 << 18)) - set(ns)) for s, ns in pages.items()}
    assert got == want


def test_import_of_one_key_leaves_other_folders_alone(spark, tmp_path):
    root = str(tmp_path)
    state = tables.conform(spark.range(1, 201).select("id", F.concat(F.lit("站"), "id").alias("enterprise_name"), F.lit(OLD).alias("created_at")),
                           schemas.POWER_FIELDS)
    tables.write_by_key(state, root, "power_fields", folders=8)
    files = lambda: {str(f) for f in (tmp_path / "power_fields-by-key").rglob("*.parquet")}
    before = files()
    for _ in range(2):  # a repeated import changes nothing more
        rows = spark.createDataFrame([(1, "站7", "5"), (2, "站7", "6")], "row_no long, enterprise_name string, capacity string")
        touched = tables.upsert_by_key(spark, root, "power_fields", rows, NOW, folders=8)
        assert len(touched) == 1
        gone = {f.split("folder=")[1][0] for f in before - files()}
        assert gone == {str(touched[0])}
        got = {r["enterprise_name"]: r for r in tables.read_by_key(spark, root, "power_fields").collect()}
        assert len(got) == 200 and (got["站7"]["id"], got["站7"]["capacity"], got["站7"]["created_at"], got["站7"]["updated_at"]) == (7, "6", OLD, NOW)
    tables.upsert_by_key(spark, root, "power_fields", rows.withColumn("enterprise_name", F.concat(F.lit("新"), "row_no")), NOW, folders=8)
    got = {r["enterprise_name"]: r["id"] for r in tables.read_by_key(spark, root, "power_fields").collect()}
    assert len(got) == 202 and (got["新1"], got["新2"]) == (201, 202)
    assert tables.upsert_by_key(spark, root, "power_fields", rows.limit(0), NOW, folders=8) == []


def test_cache_object_is_one_json_object(spark, tmp_path):
    cache = spark.createDataFrame([(f"q{i}\n", "success", str(i)) for i in range(30)] + [(None, "failed", None)], "query string, status string, lon string")
    landed.write_cache_object(cache.repartition(4), str(tmp_path / "all"))
    text = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "all").glob("part-*")))
    assert {k: v["lon"] for k, v in json.loads(text).items()} == {f"q{i}\n": str(i) for i in range(30)}
    assert sorted(r["query"] for r in landed.read_cache_object(spark, str(tmp_path / "all")).collect()) == sorted(json.loads(text))
    landed.write_cache_object(cache.limit(0), str(tmp_path / "none"))
    assert landed.read_cache_object(spark, str(tmp_path / "none")).count() == 0

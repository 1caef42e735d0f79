"""Blocks of CSV files with line breaks in cells, against Spark's whole-file reader."""

import random

import pytest

from wattlink.sources import csvio
from wattlink.sources.csvlines import inside_after, read_records

CELLS = ["a", "", " b ", '"q"', '"x\ny"', '"l1\n\nl3,""z"""', "省", '"\n"', '"' + "long\n" * 40 + '"', 'x"y', '""', '"""\n"""']


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def files(folder, seed):
    folder.mkdir()
    rnd = random.Random(seed)
    for f in range(3):
        with open(folder / f"p{f}.csv", "w", newline="", encoding="utf-8") as out:
            out.write("﻿a,b,c\n")
            for i in range(25 if f != 1 else 0):
                out.write(",".join([f"k{i}", rnd.choice(CELLS), rnd.choice(CELLS)]) + ("\n\n" if rnd.random() < 0.2 else "\n"))
    return str(folder)


@pytest.mark.parametrize("trimmed", [False, True])
def test_equal_to_the_whole_file_reader(spark, tmp_path, small_blocks, trimmed):
    folder = files(tmp_path / "many", 3 + trimmed)
    got = read_records(spark, folder, strict=True, trimmed=trimmed, number="n").orderBy("n").collect()
    want = []
    for f in range(3):
        want += [tuple(r) for r in spark.read.csv(
            f"{folder}/p{f}.csv", header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST",
            ignoreLeadingWhiteSpace=trimmed, ignoreTrailingWhiteSpace=trimmed).collect()]
    assert [tuple(r)[:3] for r in got] == want and len(want) == 50
    assert [r["n"] for r in got] == list(range(1, 51))


def test_blocks_are_read_apart(spark, tmp_path, small_blocks):
    rows = read_records(spark, files(tmp_path / "many", 8))
    assert rows.rdd.getNumPartitions() > 8
    assert "rangepartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_ragged_rows_and_open_quotes_fail_a_strict_file(spark, tmp_path, small_blocks):
    long = "1,2\n" * 60
    for k, text in enumerate((f"a,b\n{long}1\n", f"a,b\n1,2,3\n{long}", f'a,b\n{long}1,"2\n3\n')):
        path = tmp_path / f"{k}.csv"
        path.write_text(text)
        with pytest.raises(Exception):
            csvio.read_import_csv(spark, str(path)).collect()
    assert read_records(spark, str(path)).count() == 61  # the open cell runs to the end


def test_files_without_rows(spark, tmp_path):
    for name, text, columns in (("empty", "", []), ("blank", "\n\n", []), ("head", "a,b\n", ["a", "b"]), ("crlf", "a,b\r\n\r\n", ["a", "b"])):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode())
        rows = read_records(spark, str(path), number="n")
        assert rows.columns == [*columns, "n"] and rows.count() == 0


def test_line_states():
    assert [inside_after(line, False, False) for line in ('a,"b', 'a,"b"', 'a"b', '"a""', '"a"",b', '"a",b"c', ' "a')] == [
        True, False, False, True, True, False, False]
    assert [inside_after(line, True, False) for line in ("a", 'a"', 'a""', 'a","b', '",b')] == [True, False, True, True, False]
    assert inside_after(' "a', False, True)

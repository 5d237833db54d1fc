"""CSV records with line breaks in cells, cut by many tasks."""

import os
import random

import pytest

from logtide.functions.csv_text import CSV_TEXT
from logtide.sources import csv_records
from logtide.sources.csv_log import read_csv_log
from logtide.sources.csv_records import read_split_csv, split_records, stray_quotes


@pytest.fixture()
def tiny_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def whole(spark, path):
    return spark.read.options(**CSV_TEXT).options(header="true", multiLine="true", mode="PERMISSIVE").csv(path)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    with open(path, "wb") as f:
        f.write(text.encode())
    return path


def cell(rng):
    size = rng.choice([0, 1, 3, 3, 12, 300])
    t = "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", "\r", " ", "x\n\ny", "\x01"]) for _ in range(size))
    return '"' + t.replace('"', '""') + '"' if rng.random() < 0.3 or any(c in t for c in '",\n\r') else t


def test_equal_to_whole_file_reads(tiny_blocks, tmp_path):
    rng = random.Random(4)
    for f, end in enumerate(["\n", "\r\n", "\n"]):
        text = ("﻿" if f == 2 else "") + "a,b c,Bé" + end
        for _ in range(24):
            text += ",".join(cell(rng) for _ in range(rng.choice([3, 3, 3, 1, 2, 5]))) + end + (end if rng.random() < 0.1 else "")
        put(tmp_path, f"{f}.csv", text.rstrip("\r\n") if f else text)
    got = read_split_csv(tiny_blocks, str(tmp_path))
    assert got.columns == ["a", "b c", "Bé"] and got.rdd.getNumPartitions() > 8
    assert rows(got) == rows(whole(tiny_blocks, str(tmp_path)))


def test_without_broadcast(tiny_blocks, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_records, "MOST_BROADCAST", 0)
    put(tmp_path, "a.csv", "n,t\n" + "".join(f'{i},"line {i}\n{"z" * (i % 400)}\nend"\n' for i in range(60)))
    assert rows(read_split_csv(tiny_blocks, str(tmp_path))) == rows(whole(tiny_blocks, str(tmp_path)))


def test_one_cell_over_many_blocks_and_gzip(tiny_blocks, tmp_path):
    import gzip
    text = 'n,t\n1,"' + "many lines\n" * 500 + '"\n2,plain\n'
    put(tmp_path, "a.csv", text)
    (a, b) = sorted(read_split_csv(tiny_blocks, str(tmp_path)).collect())
    assert a.t == "many lines\n" * 500 and tuple(b) == ("2", "plain")
    with gzip.open(os.path.join(str(tmp_path), "b.csv.gz"), "wt") as f:
        f.write(text)
    assert rows(read_split_csv(tiny_blocks, str(tmp_path))) == sorted(2 * rows(whole(tiny_blocks, str(tmp_path / "a.csv"))))


def test_headers_over_several_lines_and_empty_files(tiny_blocks, tmp_path):
    put(tmp_path, "a.csv", '\n\n"first\nname","' + "w" * 400 + '\nx"\n1,2\n')
    put(tmp_path, "b.csv", "")
    got = read_split_csv(tiny_blocks, str(tmp_path))
    assert got.columns == whole(tiny_blocks, str(tmp_path / "a.csv")).columns and [tuple(r) for r in got.collect()] == [("1", "2")]
    assert split_records(tiny_blocks, str(tmp_path / "b.csv")).count() == 0


def test_text_that_the_rule_does_not_cover_is_refused(tiny_blocks, tmp_path):
    stray = put(tmp_path, "stray.csv", 'a,b\n5" disk,1\n3,4" y\n')
    with pytest.raises(Exception, match="unquoted cell"):
        read_split_csv(tiny_blocks, stray).collect()
    assert rows(whole(tiny_blocks, stray)) == ["('3', '4\" y')", "('5\" disk', '1')"]
    with pytest.raises(ValueError, match="not closed"):
        read_split_csv(tiny_blocks, put(tmp_path, "open.csv", 'a,b\n1,"x\n2,y\n'))
    with pytest.raises(ValueError, match="CR alone"):
        read_split_csv(tiny_blocks, put(tmp_path, "cr.csv", "a,b\r1,2\r"))
    other = put(tmp_path, "other.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_split_csv(tiny_blocks, [other, put(tmp_path, "one.csv", "a,b\n1,2\n")])


@pytest.mark.parametrize(("record", "stray"), [
    ('a,"b ""c"", d",e', False), ('"x\ny",""', False), ('"""",a', False), ("plain,\x01", False), ('a"b', True), ('a"b,"c', True),
    ('"a"b,c', True), ('"open', True), (' "a",b', True)])
def test_stray_quotes(spark, record, stray):
    from pyspark.sql import functions as F
    assert spark.createDataFrame([(record,)], "r string").select(stray_quotes(F.col("r")).alias("s")).first().s is stray


def test_access_log_by_split_records(tiny_blocks, tmp_path):
    from logtide.plans.report import run_report
    from logtide.sources.load import load_access_log
    text = "Time,Status,IP,UA,note\n" + "".join(
        f'2024-01-15T08:{i % 60:02}:00Z,200,10.0.0.{i % 7},"agent\n{i}","say ""hi"", {i}"\n' for i in range(90))
    path = put(tmp_path, "log.csv", text)
    split = read_csv_log(tiny_blocks, path, multi_line="split")
    assert split.count() == 90 and rows(split) == rows(read_csv_log(tiny_blocks, path))
    assert rows(load_access_log(tiny_blocks, path, multi_line="split")) == rows(load_access_log(tiny_blocks, path))
    with pytest.raises(ValueError, match="'split'"):
        read_csv_log(tiny_blocks, path, multi_line="no")
    out = run_report(tiny_blocks, path, str(tmp_path / "rep"), ("top_ips",), fmt="parquet", multi_line="split")
    assert tiny_blocks.read.parquet(out["_top_ips"]).agg({"total_requests": "sum"}).first()[0] == 90

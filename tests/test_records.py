"""CSV records with line ends inside quoted fields, cut from several byte ranges."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.sources import records
from broodline.sources.rcsv import read_csv_r, write_csv_r

TEXT = T.StringType()
SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", TEXT), T.StructField("u", TEXT)])


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 300 bytes, so that records and long fields cross them."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fields(seed, n):
    r = random.Random(seed)
    bits = ["a", "b c", '"', '""', "\n", "\n\n", ",", "NA", "é", "\r\n", "x" * 200, "\n" * 150, '"\n"', "line\n" * 90]
    make = lambda: r.choice([None, "", "NA", "plain", "".join(r.choice(bits) for _ in range(r.randint(1, 6)))])
    return [(i, make(), make()) for i in range(n)]


def expected(rows, flavour):
    keep = lambda t: None if t is None or t == "NA" or (t == "" and flavour == "readr") else t
    return sorted(((k, keep(t), keep(u)) for k, t, u in rows), key=lambda r: r[0])


@pytest.mark.parametrize("flavour", ["base", "readr"])
def test_round_trip_over_ranges(spark, small_ranges, tmp_path, flavour):
    rows = fields(1, 300)
    path = str(tmp_path / "t")
    write_csv_r(spark.createDataFrame(rows, SCHEMA).repartition(2), path)
    found = records.ranges(spark, path)
    assert found.line_ends and found.table.count() > 20 and not found.table.where("inside").isEmpty()
    got = sorted((tuple(r) for r in read_csv_r(spark, path, SCHEMA, flavour).collect()), key=lambda r: r[0])
    assert got == expected(rows, flavour)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_csv_module(spark, small_ranges, tmp_path, seed):
    """Files of another writer, with LF or CR LF between records, and blank lines."""
    rows = [(k, t or "", u or "") for k, t, u in fields(seed + 10, 60)]
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator=["\n", "\r\n"][seed % 2], quoting=csv.QUOTE_ALL).writerows([("k", "t", "u"), *rows])
    text = buffer.getvalue() + ["", "\n", "\n\n"][seed % 3]
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    got = sorted((tuple(r) for r in read_csv_r(spark, str(path), SCHEMA, "base").collect()), key=lambda r: r[0])
    assert got == expected(rows, "base")
    found = records.ranges(spark, str(path))
    heads = records.records(spark, found).where("header").collect()
    assert [r.record for r in heads] == ['"k","t","u"']


def test_record_over_many_ranges(spark, small_ranges, tmp_path):
    rows = [(1, "a\n" * 2000, "z"), (2, "b", "\n"), (3, "\n" * 3000, "end")]
    path = tmp_path / "in.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("k", "t", "u"), *rows])
    assert sorted(tuple(r) for r in read_csv_r(spark, str(path), SCHEMA).collect()) == rows


def test_unpaired_quotes_and_other_headers_are_errors(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('k,t,u\n1,"open,x\n2,a,b\n')
    with pytest.raises(ValueError, match="within a quoted field"):
        read_csv_r(spark, str(tmp_path / "bad.csv"), SCHEMA)
    os.mkdir(tmp_path / "d")
    (tmp_path / "d" / "a.csv").write_text('k,t,u\n1,"x\ny",z\n')
    (tmp_path / "d" / "b.csv").write_text("k,t,other\n2,x,y\n")
    with pytest.raises(Exception, match="header"):
        read_csv_r(spark, str(tmp_path / "d"), SCHEMA).collect()


def test_plain_files_keep_sparks_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    write_csv_r(spark.range(20).select(F.col("id").cast("int").alias("k"), F.lit('q"').alias("t"), F.lit("NA").alias("u")), path)
    plan = read_csv_r(spark, path, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan csv" in plan
    forced = read_csv_r(spark, path, SCHEMA, line_ends=True)
    assert sorted(forced.collect()) == sorted(read_csv_r(spark, path, SCHEMA, line_ends=False).collect())


def test_empty_file_with_a_header(spark, tmp_path):
    (tmp_path / "e.csv").write_text("k,t,u\n")
    assert read_csv_r(spark, str(tmp_path / "e.csv"), SCHEMA).count() == 0
    assert read_csv_r(spark, str(tmp_path / "e.csv"), SCHEMA, line_ends=True).count() == 0


def test_another_cut_of_the_files_is_an_error(spark, small_ranges, tmp_path):
    """The second scan must see the ranges that the first one counted."""
    path = str(tmp_path / "t")
    write_csv_r(spark.createDataFrame(fields(5, 200), SCHEMA).coalesce(1), path)
    found = records.ranges(spark, path)
    for size in ("600", "77", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        with pytest.raises(Exception, match="byte ranges changed"):
            records.records(spark, found).count()

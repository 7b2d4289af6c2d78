"""CSV sources/sinks with the two R readers' NA conventions, per-population export."""

import os
import tempfile

import pytest

from broodline.sources.rcsv import read_csv_r, write_csv_r
from broodline.sources.schemas import PAIRS_SCHEMA


def _write(text):
    d = tempfile.mkdtemp(prefix="broodline-io-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_base_vs_readr_na(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    p = _write('id,n\nA,1\n,2\nNA,NA\n"",x\n')
    base = [tuple(r) for r in read_csv_r(spark, p, schema, "base").collect()]
    readr = [tuple(r) for r in read_csv_r(spark, p, schema, "readr").collect()]
    assert base == [("A", 1), ("", 2), (None, None), ("", None)]
    assert readr == [("A", 1), (None, 2), (None, None), (None, None)]


def test_round_trip_and_partitioned_export(spark):
    rows = [("A", "n1", 2000, "F1", 1, "M1", 1, 1, "no", None, 0, 1),
            ("B", None, 2001, None, None, "M2", 2, None, None, "yes", 2, 5)]
    df = spark.createDataFrame(rows, PAIRS_SCHEMA)
    out = tempfile.mkdtemp(prefix="broodline-io-")
    write_csv_r(df, os.path.join(out, "all"))
    back = read_csv_r(spark, os.path.join(out, "all"), PAIRS_SCHEMA, "readr")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    write_csv_r(df, os.path.join(out, "by_pop"), partition_by="pop")
    assert sorted(os.listdir(os.path.join(out, "by_pop")))[:2] == ["_SUCCESS", "pop=A"] or \
        {"pop=A", "pop=B"} <= set(os.listdir(os.path.join(out, "by_pop")))


def test_columns_are_found_by_name(spark):
    """Other order, row names, more columns than wanted; a missing one is an error."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("Species", T.StringType()), T.StructField("PopID", T.StringType()),
                           T.StructField("BreedingSeason", T.IntegerType())])
    p = _write('"",PopID,Species,BreedingSeason,More\n"1",HOG,PARMAJ,1999,x\n"2",NA,"a ""q"", b",2000,y\n')
    assert [tuple(r) for r in read_csv_r(spark, p, schema).collect()] == [("PARMAJ", "HOG", 1999), ('a "q", b', None, 2000)]
    with_names = T.StructType([T.StructField("X", T.LongType()), *schema.fields])
    assert [r.X for r in read_csv_r(spark, p, with_names).collect()] == [1, 2]
    with pytest.raises(ValueError, match="no column Absent"):
        read_csv_r(spark, p, T.StructType([T.StructField("Absent", T.StringType())]))


def test_quotes_and_row_names_are_written_as_r_writes_them(spark):
    out = tempfile.mkdtemp(prefix="broodline-io-")
    df = spark.createDataFrame([(2, 'a "q", b'), (1, None)], "k int, t string").coalesce(1)
    write_csv_r(df, os.path.join(out, "t"), row_names_by=["k"])
    lines = []
    for f in sorted(os.listdir(os.path.join(out, "t"))):
        if f.endswith(".csv"):
            with open(os.path.join(out, "t", f)) as fh:
                lines += fh.read().splitlines()
    assert [x for x in lines if not x.endswith("k,t")] == ["1,1,NA", '2,2,"a ""q"", b"']
    assert {x for x in lines if x.endswith("k,t")} <= {",k,t", '"",k,t'}


def test_with_row_ord_follows_file_order(spark):
    from pyspark.sql import types as T

    from broodline.sources.tables import with_row_ord
    schema = T.StructType([T.StructField("id", T.StringType())])
    p = _write("id\n" + "\n".join(f"r{i}" for i in range(50)) + "\n")
    df = with_row_ord(read_csv_r(spark, p, schema, "readr"))
    got = [r.id for r in df.orderBy("row_ord").collect()]
    assert got == [f"r{i}" for i in range(50)]


def test_row_number_consecutive_and_sorted(spark):
    from pyspark.sql import functions as F

    from broodline.sources.rcsv import with_row_number
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        df = spark.range(0, 2000).select(((F.col("id") * 7919) % 2000).alias("k"),
                                         F.when(F.col("id") % 9 == 0, None)
                                         .otherwise(F.col("id") % 13).alias("g"))
        out = with_row_number(df, ["g", "k"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.row for r in out] == list(range(1, 2001))       # consecutive, in file order
    keys = [(r.g is None, r.g if r.g is not None else 0, r.k) for r in out]
    assert keys == sorted(keys)                                # NULL last, then k

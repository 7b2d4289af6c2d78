"""CSV readers and writers with the two R readers' NA conventions.

``base`` (``read.csv``): the text ``NA`` is missing, an empty text field stays ``""``.
``readr`` (``read_csv``): both ``NA`` and empty fields are missing.
Columns are found by their header, as R does; a wanted column that no header names is an
error. Quotes inside a field are doubled, and quoted fields may hold line ends: such files are
split into records by ``broodline.sources.records``, all others by Spark's own reader. Typed (non-string) columns are read as text and
converted with ``try_cast`` so a bad cell becomes NULL instead of failing the job (ANSI
mode).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.sources import records

QUOTING = {"quote": '"', "escape": '"'}
#: Spark's writer would cut white space, line ends included, from the ends of a field.
AS_IS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
NEVER = "\u0000NA-never\u0000"
#: Header of the row-name column: R writes it empty and reads it as X.
ROW_NAMES = "X"


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file or folder; an empty first name is ``ROW_NAMES``."""
    names = spark.read.options(**QUOTING).option("header", True).csv(path).columns
    return [ROW_NAMES if i == 0 and n in ("_c0", "") else n for i, n in enumerate(names)]


def _nulls(flavour: str) -> dict[str, str]:
    # base: keep empty unquoted fields as "" (Spark would otherwise read them as NULL)
    return {"nullValue": "NA"} if flavour == "readr" else {"nullValue": NEVER, "emptyValue": ""}


def _parsed(rows: DataFrame, n: int, flavour: str) -> DataFrame:
    """``rows`` with the first ``n`` fields of ``record`` as an array ``fields``, as text."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    one = F.from_csv("record", F.lit(schema), {**QUOTING, **_nulls(flavour), "mode": "PERMISSIVE", "multiLine": "true"})
    return rows.withColumn("_one", one).withColumn("fields", F.array(*(F.col(f"_one.c{i}") for i in range(n)))).drop("_one")


def _rows_with_line_ends(spark: SparkSession, found: records.Ranges, names: list[str], flavour: str) -> DataFrame:
    """The fields of all records as text columns ``names``; another header is an error."""
    rows = _parsed(records.records(spark, found), len(names), flavour)
    is_name = [F.get("fields", F.lit(i)) == n for i, n in enumerate(names) if n != ROW_NAMES]
    other = F.raise_error(F.concat(F.col("file"), F.lit(f" has another header than {', '.join(names)}")))
    right = F.coalesce(reduce(and_, is_name, F.lit(True)), F.lit(False))
    body = rows.where(F.when(F.col("header"), F.when(right, False).otherwise(other.cast("boolean"))).otherwise(True))
    return body.select(*(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_csv_r(spark: SparkSession, path: str, schema: T.StructType,
               flavour: str = "base", line_ends: bool | None = None) -> DataFrame:
    """The columns of ``schema`` from a CSV file or folder; see the module.

    ``line_ends``: whether quoted fields may hold line ends. By default the files are scanned
    once to see; ``False`` saves that scan where there are none.
    """
    names = header_of(spark, path)
    if missing := [f.name for f in schema.fields if f.name not in names]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(names)}")
    found = None if line_ends is False else records.ranges(spark, path)
    if found and (line_ends or found.line_ends):
        df = _rows_with_line_ends(spark, found, names, flavour)
    else:
        rd = (spark.read.schema(T.StructType([T.StructField(n, T.StringType(), True) for n in names]))
              .options(**QUOTING, **_nulls(flavour)).option("header", True).option("mode", "PERMISSIVE"))
        if ROW_NAMES not in names:
            rd = rd.option("enforceSchema", False)  # every file of a folder must have this header
        df = rd.csv(path)
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            # base: the only NULLs Spark yields here are unquoted empty fields -> ""
            c = F.nullif(F.coalesce(c, F.lit("")), F.lit("NA")) if flavour == "base" \
                else F.nullif(c, F.lit(""))
        else:
            c = F.nullif(F.nullif(c, F.lit("NA")), F.lit("")).try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_csv_each(spark: SparkSession, path: str, flavour: str = "base") -> DataFrame:
    """(file, fields) of each row of CSV files that have headers of their own: ``fields`` maps
    the column names of the row's file to its text, by the rules of the flavour."""
    found = records.ranges(spark, path)
    rows = records.records(spark, found)
    commas = F.length("record") - F.length(F.replace("record", F.lit(","), F.lit("")))
    most = rows.where("header").agg(F.max(commas)).first()[0]
    width, na = (most or 0) + 1, F.lit("NA")
    # NA names a column; only in the rows below it is a missing value
    heads = _parsed(rows.where("header"), width, "base").select("file", F.transform("fields", lambda c, i: F.when(
        (i == 0) & (F.coalesce(c, F.lit("")) == ""), F.lit(ROW_NAMES)).otherwise(c)).alias("names"))
    heads = heads.select("file", F.filter("names", lambda c: c.isNotNull()).alias("names"))
    body = _parsed(rows.where("not header"), width, flavour).join(heads, "file")
    text = F.transform(F.slice("fields", F.lit(1), F.size("names")), lambda c: F.nullif(
        F.coalesce(c, F.lit("")), na) if flavour == "base" else F.nullif(F.nullif(c, na), F.lit("")))
    return body.select("file", F.map_from_arrays("names", text).alias("fields"))


def csv_line(fields: Column) -> Column:
    """An array of texts as one CSV line: NULL is ``NA``; a field with a comma, quote or line end
    is quoted, quotes inside doubled."""
    quoted = F.transform(fields, lambda c: F.when(c.isNull(), F.lit("NA")).when(
        c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return F.array_join(quoted, ",")


def with_row_number(df: DataFrame, order: Sequence, name: str = "row") -> DataFrame:
    """Sort by ``order`` (ascending, NULL last; end it with a unique key) and number the
    rows 1..n consecutively, like the row names base R writes after ``arrange``.

    No single-partition window over the data: the range-partitioned sort tags each row
    with its partition id and its position in the partition (``monotonically_increasing_id``
    right after the sort), the tagged rows are checkpointed so the ids are fixed, and a
    prefix sum over the per-partition counts (one row per partition, a bounded table,
    hence the broadcast) gives each partition its offset. The result keeps the sorted
    partition order, so writing it yields files in row-number order.
    """
    from broodline.session import materialize
    keys = [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in order]
    tagged = materialize(df.orderBy(*keys).withColumns(
        {"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))
    j = tagged.join(F.broadcast(offsets), "_pid")
    rn = F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)) + 1
    return j.select(rn.alias(name), *df.columns)


def write_csv_r(df: DataFrame, path: str, partition_by: str | None = None,
                mode: str = "overwrite", row_names_by: Sequence | None = None) -> None:
    """``write_csv`` / ``write.csv``: header, NULL written as ``NA``, quotes doubled.

    ``partition_by`` gives one folder per value (the per-population files of the
    reference) from a single distributed write instead of a driver loop.
    ``row_names_by``: sort by these columns and put the 1..n row names that ``write.csv``
    writes by default first, under an empty header (``with_row_number``).
    """
    if row_names_by:
        df = with_row_number(df, row_names_by, "")
    w = (df.write.mode(mode).options(**QUOTING, **AS_IS).option("header", True).option("nullValue", "NA")
         .option("emptyValue", ""))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)

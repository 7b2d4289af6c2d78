"""Splitting quoted CSV into records, in parallel, where fields hold line ends.

A line end inside quotes belongs to its field, so a reader of one byte range must know
whether its range starts inside quotes. Three steps, none of which moves the lines:

1. every range counts its lines with an odd number of quotes (a partial aggregate);
2. the running total over the ranges of a file, one row for each range, says for each whether
   it starts inside quotes, and in which range the record that is open there began;
3. every range cuts its lines into records from its known start. Complete records stay where
   they are; only the parts of a record that crosses ranges are brought together.

Quotes inside a field are doubled, so they do not change the count's parity. A file whose
quotes do not pair up is an error: R warns of the end of the file within a quoted string.
Both scans must cut the files alike; Spark takes the size of ranges from the session's settings and
the number of cores, so each range is recognised by file, start and length, and another cut is an error
(``spark.sql.files.minPartitionNum`` holds it still where cores come and go).
Blank lines between records are skipped, as R does. A line ends in LF or CR LF; line ends
inside fields stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broodline.session import materialize

_RECORDS = "range int, part int, header boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"))


KEY = ["file", "start", "length"]


@dataclass
class Ranges:
    """The byte ranges of the files below a path and what each must know of those before it."""

    path: str
    #: (range, file, start, length, inside, opens, began): numbered ranges; ``inside`` quotes at the
    #: start, whether a record begins there that goes on in the next, and the range where the record
    #: that is open at the start began
    table: DataFrame
    #: whether any field holds a line end
    line_ends: bool


def ranges(spark: SparkSession, path: str) -> Ranges:
    """One scan of the files; see the module."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = _lines(spark, path).groupBy(*KEY).agg(F.count_if(quotes % 2 == 1).alias("odd"))
    # one row for each byte range from here on
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1
    numbered = odd.select(*KEY, "odd", before.alias("inside"),
                          F.row_number().over(Window.orderBy("file", "start")).alias("range"))
    through = F.col("inside") & (F.col("odd") == 0)
    opens = (F.col("inside") != (F.col("odd") % 2 == 1)) & ~through
    table = materialize(numbered.select("range", *KEY, "odd", "inside", opens.alias("opens"), F.last(
        F.when(opens, F.col("range")), ignorenulls=True).over(earlier).alias("began")))
    unpaired = table.groupBy("file").agg(F.sum("odd").alias("odd")).where("odd % 2 = 1").select("file").first()
    if unpaired:
        raise ValueError(f"{unpaired.file} ends within a quoted field")
    return Ranges(path, table.drop("odd"), not table.where("odd > 0").isEmpty())


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, range, inside, began, first) in file order -> rows of ``_RECORDS``."""
    out = pa.schema([("range", pa.int32()), ("part", pa.int32()), ("header", pa.bool_()), ("record", pa.string())])
    now, quoted, held, began, heading = None, 0, [], 0, False

    def rows(number: int, part: int | None, head: bool, records) -> pa.RecordBatch:
        records = records if isinstance(records, pa.Array) else pa.array(records, pa.string())
        n = len(records)
        return pa.RecordBatch.from_arrays([
            pa.array([number] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([head] * n), records], schema=out)

    for batch in batches:
        number = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if number[a] != now:
                if held:  # the range before ended inside a record
                    yield rows(began, now, heading, ["\n".join(held)])
                now, held = int(number[a]), []
                quoted, heading = int(batch.column(2)[a].as_py()), batch.column(4)[a].as_py()
                began = batch.column(3)[a].as_py() if quoted else now
            lines = batch.column(0).slice(a, b - a)
            odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
            after = (quoted + np.cumsum(odd)) & 1
            single = (after == 0) & (odd == 0)
            if heading and single[0] and not held and not quoted:
                yield rows(now, None, True, lines.slice(0, 1))
                heading, single[0] = False, False
                rest = np.flatnonzero(~single)[1:]
            else:
                rest = np.flatnonzero(~single)
            if single.any():
                yield rows(now, None, False, lines.filter(pa.array(single)))
            for i in rest.tolist():
                held.append(lines[i].as_py())
                if after[i] == 0:
                    text, held = ["\n".join(held)], []
                    yield rows(began, None if began == now else now, heading, text)
                    began, heading = now, False
            quoted = int(after[-1])
    if held:
        yield rows(began, now, heading, ["\n".join(held)])


def records(spark: SparkSession, found: Ranges) -> DataFrame:
    """(file, header, record): every record of the files; ``header`` marks a file's first."""

    def cut(wanted: Column) -> DataFrame:
        # a row for each byte range, joined where the lines are read, so their order stays
        known = found.table.select(*KEY, "range", "inside", "began", (F.col("start") == 0).alias("first"), wanted.alias("wanted"))
        lines = _lines(spark, found.path).join(F.broadcast(known), KEY, "left")
        other = F.raise_error(F.concat(F.lit("the byte ranges changed between two scans of "), F.col("file")))
        lines = lines.where(F.when(F.col("range").isNull(), other.cast("boolean")).otherwise(F.col("wanted")))
        return lines.select("value", "range", "inside", "began", "first").mapInArrow(_cut, _RECORDS)

    whole = cut(F.lit(True)).where("part is null").select("range", "header", "record")
    # only ranges that share a record with another are read again
    parts = cut(F.col("inside") | F.col("opens")).where("part is not null").groupBy("range").agg(
        F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("part", "record"))).alias("parts"))
    joined = parts.select("range", "header", F.array_join(F.col("parts.record"), "\n").alias("record"))
    rows = whole.unionByName(joined)
    text = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return rows.join(F.broadcast(found.table.select("range", "file")), "range").select(
        "file", "header", text.alias("record")).where("record <> ''")

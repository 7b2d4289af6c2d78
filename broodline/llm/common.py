"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64
ROWS = 1000  # rows of a batch that are turned into Python objects together


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit flips about half of the output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """``n`` fixed 64-bit values, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(start, start + n, dtype=U64) * U64(0x9E3779B97F4A7C15))


def map_batches(df: DataFrame, make: Callable[[], Callable[..., list]], schema: T.StructType) -> DataFrame:
    """``make()`` runs once in a task and returns a function from the Arrow columns of some
    rows (``ROWS`` at most, in the order of ``df.columns``) to the output columns."""
    names = schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, fn = to_arrow_schema(schema), make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                columns = fn(*batch.slice(at, ROWS).columns)
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, out.field(n).type)
                          for n, c in zip(names, columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list]],
                fields: list[T.StructField]) -> DataFrame:
    """All columns of ``df`` plus ``fields``, which ``make()(*inputs)`` computes by batch.

    A field that has the name of a column replaces it, in its place.
    """
    at = {n: i for i, n in enumerate(df.columns)}
    new = {f.name: f for f in fields}
    schema = T.StructType([new.get(f.name, f) for f in df.schema]
                          + [f for f in fields if f.name not in at])

    def wrapped():
        fn = make()

        def apply(*columns):
            made = dict(zip(new, fn(*(columns[at[n]] for n in inputs))))
            return [made.get(n, columns[at[n]] if n in at else None) for n in schema.fieldNames()]

        return apply

    return map_batches(df, wrapped, schema)

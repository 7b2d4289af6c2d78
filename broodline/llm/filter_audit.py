"""How text filters interact: what each one removes first, again or alone.

The words of all texts become a sparse document-term matrix. Tasks read whole texts in chunks
and number the distinct words of a chunk; all chunks' words meet in one dictionary, which gives each
word its number in the whole corpus, and the numbers go back to their chunks, so that each chunk
becomes a CSR shard (row starts, word numbers, counts) over the columns of the whole corpus. A row's sum is its number of words,
its stored entries are its distinct words; these decide filters A and B:

    A  fewer than 50 words                      D  holds any of # $ % & * |
    B  100 * distinct words < 65 * words        E  the text of a smaller doc_id, table-wide
    C  100 * [A-Z] characters > 5 * characters

The other flags are attached, rows are counted by (part, failed filters), and the 120 orders
of the five filters are read off those counts: at most 32 of them for a part, so the orders
cost the same whatever the number of documents.

E needs no join of rows: equal texts fail the same filters, so a text's rows are counted by
(text, part, labels), with the smallest id of each, and the smallest id of the text decides.
Texts are identified by SHA-256.

Memory: a task holds one chunk (``CHUNK`` bytes, or one longer text) and the numbers of its
words. In the dictionary a word has one row for each chunk, however often it occurs there.
Chunks are written to the shared folder before their words are used, so a lost executor
cannot number them anew.

Defined results: a null or empty text has no words (it fails A, and E if an earlier one has no
text either). Very long texts are read whole. A null doc_id is not smaller than any other, does
not fail E, and has no labels. Rows that repeat a doc_id count one by one and do not fail E by
each other. A doc_id with several labels has each label that one of them gives. A null source
is the part ``''``. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.session import stage

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of the words
MOST_CAPITALS = 5  # percent of the characters
SYMBOLS = b"#$%&*|"
CHUNK = 10_000_000  # bytes of a chunk
BUCKETS = 4  # of the dictionary, for each shuffle partition

def _arrays(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(t)) for n, t in kinds.items()]


def _buffers(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.BinaryType()) for n in names]


#: The CSR arrays are buffers of ``packed`` integers; the other arrays have one entry for each row.
_SHARD = [T.StructField("shard", T.StringType())] + _arrays(
    doc_ids=T.LongType(), parts=T.StringType(), texts=T.BinaryType(), capitals=T.IntegerType(), chars=T.IntegerType(),
    symbols=T.BooleanType()) + _buffers("starts", "counts")
CHUNKS = T.StructType(_SHARD + _buffers("slots") + _arrays(words=T.StringType()))
SHARDS = T.StructType(_SHARD + _buffers("columns"))
FLAGS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("text", T.BinaryType()),
    T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType()), T.StructField("failed", T.IntegerType())])


def packed(values: np.ndarray) -> bytes:
    """64-bit integers as their number and compressed little-endian bytes."""
    raw = np.ascontiguousarray(values, "<i8")
    return len(raw).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), "<i8")


def _chunk(name: str, rows: list[tuple]) -> dict:
    """CSR of some texts over the chunk's own words, in the order of their first occurrence."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    slots, counts, starts = [], [], [0]
    capitals, chars, symbols, digests = [], [], [], []
    for _, _, text in rows:
        found = Counter(text.split())  # bytes split at \x20 and \x09-\x0D exactly
        slots.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        counts.append(np.fromiter(found.values(), np.int32, len(found)))
        starts.append(starts[-1] + len(found))
        raw = np.frombuffer(text, np.uint8)
        capitals.append(int(np.count_nonzero(raw - np.uint8(65) < 26)))
        chars.append(int(np.count_nonzero(raw & 0xC0 != 0x80)))  # bytes that start a character
        symbols.append(any(c in text for c in SYMBOLS))
        digests.append(hashlib.sha256(text).digest())
    return {"shard": name, "doc_ids": [r[0] for r in rows], "parts": [r[1] for r in rows], "capitals": capitals,
            "chars": chars, "symbols": symbols, "texts": digests, "starts": packed(starts),
            "slots": packed(np.concatenate(slots)), "counts": packed(np.concatenate(counts)), "words": list(number)}


def _one_row(made: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        v = made[f.name]
        if pa.types.is_list(f.type):
            if f.name == "words":
                values = pa.array(v, pa.binary()).cast(pa.string())
            else:
                values = pa.array(v, f.type.value_type)
            v = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(f.type)
        else:
            v = pa.array([v], f.type)
        arrays.append(v)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, held, rows, n = to_arrow_schema(CHUNKS), 0, [], itertools.count()
        task = TaskContext.get().partitionId()
        for batch in batches:
            ids, parts, texts = batch.columns
            texts = texts.cast(pa.binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                if rows and held + len(text) > CHUNK:
                    yield _one_row(_chunk(f"{task}-{next(n)}", rows), out)
                    rows, held = [], 0
                    pa.default_memory_pool().release_unused()
                rows.append((ids[i].as_py(), parts[i].as_py(), text))
                held += len(text)
        if rows:
            yield _one_row(_chunk(f"{task}-{next(n)}", rows), out)

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long"), part, "text").mapInArrow(run, CHUNKS)


def _numbered(chunks: DataFrame) -> DataFrame:
    """(shard, slot, word, id): the corpus-wide number of each chunk's words. Words are dealt into
    buckets by a hash and ranked in a bucket's order; ``id`` is the rank, counted from 0, times
    the number of buckets, plus the bucket. The rank is a running count over a sorted stream."""
    buckets = BUCKETS * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = chunks.select("shard", F.posexplode("words").alias("slot", "word")).withColumn(
        "bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")) - 1
    return words.select("shard", "slot", "word", (rank.cast("long") * buckets + F.col("bucket")).alias("id"))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks with the numbers of their words, and the dictionary."""
    chunks = stage(_chunks(docs))
    words = _numbered(chunks)
    # both lists are made of the same rows in the same order
    numbers = words.groupBy("shard").agg(F.collect_list("slot").alias("at"), F.collect_list("id").alias("ids"))
    # a chunk without any word has no row there
    return chunks.drop("words").join(numbers, "shard", "left"), words.select("word", "id").distinct()


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined chunks -> CSR shards."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(SHARDS)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}
            columns = unpacked(row["slots"].as_py())
            if len(columns):
                at, ids = (row[n].values.to_numpy(zero_copy_only=False) for n in ("at", "ids"))
                of_slot = np.empty(len(ids), np.int64)
                of_slot[at] = ids
                columns = of_slot[columns]
            made = {f.name: row[f.name].values if pa.types.is_list(f.type) else row[f.name].as_py() for f in out if f.name in row}
            yield _one_row(made | {"columns": packed(columns)}, out)


def _flags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CSR shards -> a row of ``FLAGS`` for each document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(FLAGS)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}
            capitals, chars, symbols = (row[n].values.to_numpy(zero_copy_only=False).astype(np.int64) for n in ("capitals", "chars", "symbols"))
            starts, counts = unpacked(row["starts"].as_py()), unpacked(row["counts"].as_py())
            sums = np.concatenate([[0], np.cumsum(counts)])
            words, distinct = sums[starts[1:]] - sums[starts[:-1]], np.diff(starts)
            failed = ((words < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * words).astype(np.int64) << 1
                      | (100 * capitals > MOST_CAPITALS * chars).astype(np.int64) << 2 | symbols << 3)
            made = (row["doc_ids"].values, row["parts"].values, row["texts"].values, words, distinct, failed)
            yield pa.RecordBatch.from_arrays([pa.array(v).cast(f.type) for v, f in zip(made, out)], schema=out)


def document_term_matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary): CSR shards and (word, id). A shard's ``columns`` are ids of the
    dictionary; ``starts`` has one entry more than there are rows; ``unpacked`` gives the arrays.
    Neither is stored here; the chunks are, in the shared folder."""
    whole, words = _joined(docs)
    return whole.mapInArrow(_shards, SHARDS), words


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text, n_words, n_distinct, failed) for each row, from its CSR shard: ``text``
    identifies equal texts, ``failed`` has bit k for the k-th of the filters A to D. The worker that
    builds a shard reads it, so a task runs one worker."""
    whole, _ = _joined(docs)
    return whole.mapInArrow(lambda batches: _flags(_shards(batches)), FLAGS)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents by the set of filters that they fail."""
    rows = stage(flags(docs)).groupBy("doc_id", "part", "text", "failed").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # unknown ids match nothing; the second key spreads them. It is 0 for known ones, but no constant, which
    # the optimizer would take out of the join's keys
    marks = marks.withColumn("spread", F.pmod(F.col("doc_id"), F.lit(1)).cast("long"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    rows = rows.join(marks, ["doc_id", "spread"], "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    known = F.col("doc_id").isNotNull()
    by_text = rows.groupBy("text", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_known"),
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = by_text.groupBy("text").agg(F.min("least").alias("first"))
    copies = F.col("n_known") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    both = by_text.join(first, "text").withColumn("copies", copies).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("failed"), (F.col("n") - F.col("copies")).alias("n")),
            F.struct((F.col("failed") + 16).alias("failed"), F.col("copies").alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.groupBy("part", F.col("x.failed").alias("failed")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def _orders() -> Column:
    """The steps of all orders: order, step, the step's filter and those before it as bits."""
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        for k, i in enumerate(order):
            steps.append(F.struct(F.lit(name).alias("filter_order"), F.lit(k + 1).alias("step"),
                                  F.lit(1 << i).alias("bit"), F.lit(sum(1 << j for j in order[:k])).alias("before")))
    return F.array(*steps)


def audit(counts: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic) -> one row for each part, order of the filters and step."""
    table = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    rows = table.select("part", "sets", F.explode(_orders()).alias("s")).select("part", "sets", "s.*")

    def total(value: str, when) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("sets", zero, lambda acc, x: acc + F.when(when(x["failed"]), x[value]).otherwise(zero))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda f: f.bitwiseAND(bit) != 0
    earlier = lambda f: f.bitwiseAND(before) != 0
    here = lambda f: fails(f) & ~earlier(f)
    # of a set of k filters each comes first in 120 / k orders
    share = lambda f: F.lit(120).cast("long") / F.bit_count(f)
    shapley = F.aggregate("sets", F.lit(0).cast("long"), lambda acc, x: acc + F.when(
        fails(x["failed"]), x["n"] * share(x["failed"]).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda f: f.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"), total("n", lambda f: fails(f) & earlier(f)).alias("redundant"),
        total("n", lambda f: f == bit).alias("unique_fails"), total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"), shapley.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_counts(docs, labels))

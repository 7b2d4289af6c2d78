"""Packing token sequences by cutting-stock column generation.

A document's tokens, closed by id 0, are cut at every multiple of ``SIZE``: full pieces are
sequences of their own, and the remainders are the stock to be combined. The histogram of
remainders by length class (lengths in steps of ``UNIT``, so at most SIZE / UNIT rows, whatever
the corpus) goes to the driver, where a linear program chooses how often to use each pattern
(a multiset of classes that fits into a sequence): a dynamic-programming knapsack over the
current prices proposes patterns until none improves, or the bound shows that the rest is
worth less than ``GAP`` of the sequences. Pattern counts are rounded down and what remains is
placed best-fit decreasing. The steps cost 3.5 ids of padding a remainder on average; exact
lengths would save them, but a program of 1,023 rows did not come near its optimum in 30 s,
where 128 rows are solved to the end in 2.

Every pattern use has numbered slots for each class, and the documents of a class are
ranked; rank k takes slot k. Ranks come from counts of (class, shard) and positions inside
a shard, the counts summed up in blocks of ``BLOCK`` shards and over the blocks, so no task ever
sees all documents of one class or all shards, and a document meets its slot in
a join with the slot table (a few rows for each pattern). The offset of a piece is the
length of those before it in its sequence, a window of at most SIZE rows.

Token ids are those of the ``tokenizers`` vocabulary with its defaults: a text that spells an
added token (``<|endoftext|>``) gets that token's id. Texts of the common Latin characters
without such a string go through ``tiktoken`` with the same vocabulary and merges, which gives
the same ids at a quarter of the CPU time; all others go through ``tokenizers`` itself. Very
long texts are encoded whole.

Defined results: a null or empty text is one piece of the single id 0. Rows that repeat a
doc_id are packed each on their own; documents of the same class, id and checksums are
interchangeable. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from broodline.llm.common import map_batches
from broodline.session import stage

SIZE = 1024
UNIT = 8
ROOM = SIZE // UNIT  # units of a sequence
GAP = 2e-4
SHARD = 20_000  # documents that are ranked together, in expectation
BLOCK = 1000  # shards that are summed up together
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_UNCOMMON = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ſ–—‘-”…€]")


def file_of(name: str) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def read_ranks(name: str) -> dict[bytes, int]:
    with open(file_of(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """``ids(text)``: the token ids of a text as unsigned 32-bit integers."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        import tiktoken

        self.vocabulary, self.exact = vocabulary, None
        with open(file_of(vocabulary), encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=read_ranks(ranks), special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not _UNCOMMON.search(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.exact is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(file_of(self.vocabulary))
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(doc_id, doc_tokens, crcs): crcs has the checksum of each piece of SIZE ids."""

    def make():
        encoder = Encoder(vocabulary, ranks)

        def apply(ids, texts):
            tokens, crcs, ends = [], [], [0]
            for text in texts:
                x = np.append(encoder.ids(text.as_py()), 0).astype("<u4")
                tokens.append(len(x))
                crcs += [zlib.crc32(x[a : a + SIZE].tobytes()) for a in range(0, len(x), SIZE)]
                ends.append(len(crcs))
            return [ids, tokens, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(crcs, pa.int64()))]

        return apply

    return map_batches(docs.select("doc_id", "text"), make, T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("doc_tokens", T.LongType()),
        T.StructField("crcs", T.ArrayType(T.LongType()))]))


def _knapsack(lengths: np.ndarray, price: np.ndarray, many: int = 4) -> tuple[float, list[np.ndarray]]:
    """The best value of a pattern, and up to ``many`` of the best patterns that contain
    each a different length."""
    value, choice = np.zeros(ROOM + 1), np.full(ROOM + 1, -1)
    for c in range(1, ROOM + 1):
        fit = np.searchsorted(lengths, c, "right")
        value[c] = value[c - 1]
        if fit:
            got = value[c - lengths[:fit]] + price[:fit]
            best = got.argmax()
            if got[best] > value[c] + 1e-12:
                value[c], choice[c] = got[best], best
    with_each = price + value[ROOM - lengths]
    patterns, seen = [], set()
    for first in np.argsort(-with_each, kind="stable")[:many]:
        if with_each[first] <= 1 + 1e-9:
            break
        pattern = np.zeros(len(lengths), np.int64)
        pattern[first], c = 1, ROOM - lengths[first]
        while c > 0:
            if choice[c] < 0:
                c -= 1
                continue
            pattern[choice[c]] += 1
            c -= lengths[choice[c]]
        if (key := pattern.tobytes()) not in seen:
            seen.add(key)
            patterns.append(pattern)
    return value[ROOM], patterns


def linear_program(lengths: np.ndarray, demand: np.ndarray, gap: float = GAP,
                   rounds: int = 6000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each: a basis of the cutting-stock program."""
    m = len(lengths)
    basis = [np.eye(m, dtype=np.int64)[i] * (ROOM // lengths[i]) for i in range(m)]
    inverse = np.diag(1.0 / (ROOM // lengths))
    use = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        best, patterns = _knapsack(lengths, price)
        if best <= 1 + 1e-9 or 1 - 1 / best < gap:  # the bound is the current value over best
            break
        for pattern in patterns:
            if inverse.sum(axis=0) @ pattern <= 1 + 1e-9:
                continue
            column = inverse @ pattern
            ratio = np.where(column > 1e-9, use / np.where(column > 1e-9, column, 1), np.inf)
            out = int(ratio.argmin())
            step = ratio[out]
            use = np.maximum(use - step * column, 0)
            use[out] = step
            row = inverse[out] / column[out]
            inverse -= np.outer(column, row)
            inverse[out] = row
            basis[out] = pattern
    return list(zip(basis, use))


def _best_fit(lengths: np.ndarray, demand: np.ndarray) -> list[dict[int, int]]:
    """Patterns for a small rest: longest first, each into the fullest sequence it fits."""
    room: dict[int, list[dict[int, int]]] = {}
    done = []
    for i in np.argsort(-lengths):
        length = int(lengths[i])
        for _ in range(int(demand[i])):
            spare = min((r for r, open_ in room.items() if r >= length and open_), default=None)
            pattern = room[spare].pop() if spare is not None else {}
            if not pattern:
                done.append(pattern)
                spare = ROOM
            pattern[length] = pattern.get(length, 0) + 1
            room.setdefault(spare - length, []).append(pattern)
    return done


def plan(histogram: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (class, first rank, end rank, first sequence, slots in a sequence, number of the
    first slot), and the number of sequences, for counted classes (lengths in units)."""
    if not histogram:
        return [], 0
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    uses: list[tuple[dict[int, int], int]] = []
    left = demand.copy()
    for pattern, use in linear_program(lengths, demand.astype(float)):
        n = int(use + 1e-6)
        n = min([n, *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if n > 0:
            left -= n * pattern
            uses.append(({int(lengths[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, n))
    uses += [(p, 1) for p in _best_fit(lengths, left)]
    slots, sequence, ranked = [], 0, dict.fromkeys(histogram, 0)
    for pattern, n in uses:
        number = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            slots.append((length, ranked[length], ranked[length] + n * k, sequence, k, number))
            ranked[length] += n * k
            number += k
        sequence += n
    return slots, sequence


def sums_before(counts: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``counts`` with the sum of ``value`` over the smaller shards of the same ``by``, as ``out``:
    sums inside blocks of ``BLOCK`` shards, and sums over the blocks before."""
    block = F.floor(F.col("shard") / BLOCK)
    rows = counts.withColumn("_block", block)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(blocks, [*by, "_block"])
    return rows.withColumn(out, F.col(out) + F.col("_before")).drop("_block", "_before")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    spark = docs.sparkSession
    rows = stage(token_pieces(docs, vocabulary, ranks))
    shards = rows.count() // SHARD + 1
    rest = F.col("doc_tokens") % SIZE
    rows = rows.select("*", rest.alias("rest"), F.ceil(rest / UNIT).alias("class"),
                       F.floor(F.col("doc_tokens") / SIZE).alias("full"),
                       F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(shards)).alias("shard"))
    counted = stage(rows.groupBy("shard", "class").agg(F.count("*").alias("n"), F.sum("full").alias("full")))
    histogram = {int(c): int(n) for c, n in
                 counted.where("class > 0").groupBy("class").agg(F.sum("n")).collect()}  # ROOM rows at most
    slots, sequences = plan(histogram)

    first_rank = sums_before(counted, ["class"], "n", "first_rank").select("shard", "class", "first_rank")
    full = counted.groupBy("shard").agg(F.sum("full").alias("full"))
    first_full = sums_before(full, [], "full", "first_full").select(
        "shard", (F.col("first_full") + sequences).alias("first_full"))

    inside = Window.partitionBy("shard", "class").orderBy("doc_id", "crcs")
    earlier = Window.partitionBy("shard").orderBy("class", "doc_id", "crcs").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (rows.withColumn("at", F.row_number().over(inside) - 1)
              .withColumn("full_at", F.coalesce(F.sum("full").over(earlier), F.lit(0)))
              .join(first_rank, ["shard", "class"]).join(first_full, "shard")
              .select("doc_id", "doc_tokens", "crcs", "rest", "class", "full",
                      (F.col("first_rank") + F.col("at")).alias("rank"),
                      (F.col("first_full") + F.col("full_at")).alias("first")))
    table = spark.createDataFrame(slots, "slot_class long, lo long, hi long, sequence long, per long, number long")
    local = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("lo"))
                         & (F.col("rank") < F.col("hi")), "left")
    pieces = placed.select("*", F.posexplode("crcs").alias("i", "ids_crc32"))
    is_full = F.col("i") < F.col("full")
    pieces = pieces.select(
        "doc_id", (F.col("i").cast("long") * SIZE).alias("start"),
        F.when(is_full, F.lit(SIZE).cast("long")).otherwise(F.col("rest")).alias("length"), "ids_crc32", "doc_tokens",
        F.when(is_full, F.col("first") + F.col("i"))
        .otherwise(F.col("sequence") + F.floor(local / F.col("per"))).alias("sequence_id"),
        F.when(is_full, F.lit(0)).otherwise(F.col("number") + F.pmod(local, F.col("per"))).alias("slot"))
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).drop("slot")

"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct shingles of ``width`` consecutive words; a document
with fewer words has its whole word sequence as its one shingle. Documents are linked when
the Jaccard similarity of their sets is at least ``percent``/100, and a component is what
links connect.

Tensored banding: two collections of ``m`` half keys each are formed, a half key being a
pair of MinHash values. The m * m tables of the search are all combinations of a half key
of the first collection with one of the second, so 4 * m MinHash values serve m * m tables
of 4 values each (32 instead of 256 for m = 8). A pair of similarity s meets in some table
with probability (1 - (1 - s^2)^m)^2: 0.9994 at 0.8, above 0.9999 from 0.85 on.

What happens to a candidate pair is exact: links are confirmed on the full sets.

1. Documents of equal sets form one class (an aggregate by a 128-bit digest of the set), so
   exact copies cost one row, however many there are.
2. In each bucket of a table the class that meets the most others is the centre; every
   member is compared with the centre only, which costs a row for each member. The base
   text of a group of copies is the centre of most of its buckets.
3. Members of buckets that are still in several components are compared with each other,
   under every half key of the first collection that they share, in square blocks of
   bounded size inside tasks. A block compares pairs of different components: first by
   their MinHash values (fewer than 14 of 32 agreements has a chance below one in a million
   at similarity 0.8), then by their sets. Only links leave the task, never pairs.

Defined results: a null text counts as empty; a text without words has an empty set, is
linked with nothing and is its own component. Letters A-Z are lower-cased; words are
separated by ASCII white space. Rows that share a doc_id count as one document (that with
the smallest set digest). Rows without doc_id are left out. Tables without rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.llm.common import U64, add_columns, fresh, map_batches, mix64, seeds
from broodline.llm.components import connected_components
from broodline.session import materialize, stage

M = 8  # half keys in each collection
HASHES = 4 * M
#: Of HASHES values, how many must agree before a pair is compared in full.
AGREE = 14
BLOCK = 4096  # documents in one side of a block, in expectation
MARKS = 1 << 25  # bits that tell which documents may be needed again
ELEMENTS = 2_000_000  # shingles in one side of a block, in expectation

_ADD, _MULTIPLY = seeds(HASHES)[:, None], seeds(HASHES, 1000)[:, None] | U64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, U64)
    for i in range(width):
        out = mix64(out + h[i : len(h) - width + 1 + i] + U64(i + 1))
    return np.unique(out)


def minhashes(hashes: np.ndarray, part: int = 4096) -> np.ndarray:
    """The least 32-bit value of each of the hash functions over a set."""
    least = np.full(HASHES, np.iinfo(U64).max, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), part):  # long texts in bounded memory
            x = (hashes[None, at : at + part] ^ _ADD) * _MULTIPLY
            x ^= x >> U64(29)
            np.minimum(least, (x * U64(0x9E3779B97F4A7C15)).min(axis=1), out=least)
    return (least >> U64(32)).astype(np.uint32).view(np.int32)


def row_signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of each row with a doc_id."""

    def make():
        def apply(ids, texts):
            n, digest, sig = [], [], []
            for text in texts.to_pylist():
                h = shingle_hashes(text, width)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                sig.append(minhashes(h))
            flat = pa.array(np.concatenate(sig) if sig else np.empty(0, np.int32))
            offsets = pa.array(np.arange(0, HASHES * (len(n) + 1), HASHES, dtype=np.int32))
            return [ids, n, digest, pa.ListArray.from_arrays(offsets, flat)]

        return apply

    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])
    return map_batches(docs.select("doc_id", "text").where("doc_id is not null"), make, schema)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig), one row per doc_id: of several texts of an id, the one
    with the smallest digest."""
    rows = row_signatures(docs, width)
    return (rows.groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles", "sig")).alias("d"))
            .select("doc_id", "d.n_shingles", "d.digest", "d.sig"))


def marked(df: DataFrame, column: str, ids: DataFrame, mark: str) -> DataFrame:
    """``df`` with a boolean ``mark``: false only where ``column`` is surely not in ``ids``.

    The ids are hashed to ``MARKS`` bits, which are broadcast as at most MARKS / 64 words, a
    fixed bound. More ids than bits only means more rows that an exact join must look at.
    """
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(MARKS))
    words = (ids.select(F.shiftright(place, 6).alias("_word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
             .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_bits")))
    own, word, bits = F.pmod(F.xxhash64(column), F.lit(MARKS)), fresh(df, "_word"), fresh(df, "_bits")
    words = words.toDF(word, bits)
    hit = F.col(bits).bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), {MARKS}) & 63 as int))")) != 0
    return (df.withColumn(word, F.shiftright(own, 6)).join(F.broadcast(words), word, "left")
            .withColumn(mark, F.coalesce(hit, F.lit(False))).drop(word, bits))


def likely(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be in ``ids``, without moving the others."""
    mark = fresh(df, "_likely")
    return marked(df, column, ids, mark).where(mark).drop(mark)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the ``wanted``(id, digest) documents."""

    def make():
        def apply(ids, digests, texts):
            keep, sets = [], []
            for digest, text in zip(digests.to_pylist(), texts.to_pylist()):
                h = shingle_hashes(text, width)
                keep.append(xxhash.xxh3_128_digest(h.tobytes()) == digest)
                sets.append(h.view(np.int64))
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            return [ids, keep, pa.ListArray.from_arrays(pa.array(offsets), flat)]

        return apply

    schema = T.StructType([
        T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("same", T.BooleanType()),
        T.StructField("shingles", T.ArrayType(T.LongType()))])
    texts = (likely(docs.select(F.col("doc_id").alias("id"), "text"), "id", wanted.select("id")).join(wanted, "id")
             .select("id", "digest", "text"))
    return map_batches(texts, make, schema).where("same").select("id", "shingles")


def _confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs``(u, v) whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = _sets(docs, classes.select("id", "digest").join(ids, "id"), width)
    met = (pairs.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
           .select("u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"),
                   F.size(F.array_intersect("su", "sv")).alias("both")))
    return met.where(100 * F.col("both") >= percent * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def _agreeing(a: str, b: str) -> F.Column:
    """How many MinHash values two signatures share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)


def _sizes_allow(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _links_in_blocks(rest: DataFrame, percent: int) -> DataFrame:
    """(u, v): the links between different components among ``rest``(id, comp, size, sig,
    shingles) that agree in a half key of the first collection.

    The members of a half key are dealt to parts of bounded size, and every two parts meet
    in one block, which one task compares: by MinHash values as arrays, then exactly by the
    sets. Only links leave the task. A pair is compared under its first common half key.
    """
    halves = F.posexplode(_half_keys(0)).alias("i", "x")
    groups = (rest.select("id", "comp", "size", halves).groupBy("i", "x")
              .agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
              .where("lo <> hi").select("i", "x", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / ELEMENTS))
                                        .cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("id", "i"), F.col("parts")).cast("int")
    dealt = (rest.select("*", halves).join(groups, ["i", "x"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("i", "x", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     "own", "id", "comp", "size", "sig", "shingles"))
    spread = dealt.repartition("i", "x", "lo", "hi").sortWithinPartitions("i", "x", "lo", "hi")
    id_type = rest.schema["id"].dataType

    def links(group: tuple, rows: list) -> tuple[list, list]:
        i, _, lo, hi = group
        own, ids, comps, sizes = (np.array([r[k] for r in rows]) for k in range(4))
        sigs = np.array([r[4] for r in rows])
        pairs_of = sigs[:, : 2 * i].reshape(len(rows), -1, 2)
        left, right = [], []
        for k in range(len(rows) - 1):
            other = comps[k + 1 :] != comps[k]
            if lo != hi:
                other &= own[k + 1 :] != own[k]
            a, b = sizes[k + 1 :], sizes[k]
            other &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            at = k + 1 + np.flatnonzero(other)
            at = at[(sigs[at] == sigs[k]).sum(axis=1) >= AGREE]
            if i and len(at):  # met under an earlier half key
                at = at[~(pairs_of[at] == pairs_of[k]).all(axis=2).any(axis=1)]
            for j in at.tolist():
                both = len(np.intersect1d(rows[k][5], rows[j][5], assume_unique=True))
                if 100 * both >= percent * (sizes[k] + sizes[j] - both):
                    left.append(ids[k].item())
                    right.append(ids[j].item())
        return left, right

    def run(batches):
        group, held, kind = None, [], pa.int64()

        def found():
            u, v = links(group, held) if len(held) > 1 else ([], [])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])

        for batch in batches:
            kind = batch.schema.field("id").type
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:4])))
            plain = list(zip(*(c.to_pylist() for c in batch.columns[4:8])))
            for row, key in enumerate(keys):
                if key != group:
                    yield from found()
                    group, held = key, []
                held.append((*plain[row], *(c[row].values.to_numpy() for c in batch.columns[8:10])))
        yield from found()

    return spread.mapInArrow(run, T.StructType([T.StructField("u", id_type), T.StructField("v", id_type)]))


def _half_keys(start: int) -> F.Column:
    """The half keys of a collection, from its first value at ``start`` of ``sig`` on."""
    return F.transform(F.sequence(F.lit(0), F.lit(M - 1)), lambda i: F.xxhash64(
        F.get("sig", i * 2 + start), F.get("sig", i * 2 + start + 1), i))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per doc_id; see the module."""
    signed = stage(signatures(docs, width))
    classes = stage(signed.where("n_shingles > 0").groupBy("digest")
                    .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig")))
    tables = (classes.select("id", _half_keys(0).alias("a"), _half_keys(2 * M).alias("b"))
              .select("id", "b", F.posexplode("a").alias("i", "x"))
              .select("id", "i", "x", F.posexplode("b").alias("j", "y"))
              .select("id", F.xxhash64("i", "x", "j", "y").alias("key")))
    buckets = tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(tables.join(buckets, "key"))

    reach = members.groupBy("id").agg(F.sum("n").alias("reach"))
    centres = (members.join(reach, "id").groupBy("key")
               .agg(F.max_by("id", F.struct("reach", -F.col("id"))).alias("centre")))
    known = classes.select("id", "size", "sig")
    pairs = (members.join(centres, "key").where("id <> centre")
             .select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct())
    pairs = (pairs.join(known.toDF("u", "nu", "su"), "u").join(known.toDF("v", "nv", "sv"), "v")
             .where(_sizes_allow(F.col("nu"), F.col("nv"), percent) & (_agreeing("su", "sv") >= AGREE))
             .select("u", "v"))
    links = materialize(_confirmed(docs, stage(pairs), classes, width, percent))
    comps = connected_components(links)

    placed = (members.where("n > 2").join(comps, "id", "left")
              .select("key", "n", "id", F.coalesce("comp", "id").alias("comp")))
    split = (placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("lo <> hi").select("key"))
    open_ids = stage(placed.join(split, "key").select("id", "comp").distinct()
                     .join(classes, "id").select("id", "comp", "digest", "size", "sig"))
    if not open_ids.isEmpty():
        rest = open_ids.join(_sets(docs, open_ids.select("id", "digest"), width), "id")
        more = materialize(_links_in_blocks(rest.drop("digest"), percent))
        if not more.isEmpty():
            comps = connected_components(links.union(more))

    named = classes.select("digest", "id").join(comps, "id", "left").select(
        "digest", F.coalesce("comp", "id").alias("component_id"))
    return (signed.join(named, "digest", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the
    smallest doc_id stays, once. Rows without doc_id stay.

    Where a doc_id has several texts, the one with the smallest digest stands for the id and is
    judged; each other text of the id stays, once.

    Only rows whose id may be dropped or repeated are moved to decide on them.
    """
    signed = stage(near_duplicates(docs, width, percent).select("doc_id", "kept"))
    repeated = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    mark = fresh(docs, "_affected")
    rows = marked(docs, "doc_id", signed.where("not kept").select("doc_id").union(repeated), mark)
    rows = rows.withColumn(mark, F.col(mark) & F.col("doc_id").isNotNull())
    affected = rows.where(mark).drop(mark)
    out = rows.where(~F.col(mark)).drop(mark).select(docs.columns)
    if repeated.isEmpty():
        kept = affected.join(signed.where("kept").select("doc_id"), "doc_id", "left_semi")
        return out.unionByName(kept.select(docs.columns))
    single = affected.join(repeated, "doc_id", "left_anti").join(signed.where("kept").select("doc_id"), "doc_id", "left_semi")
    several = affected.join(repeated, "doc_id", "left_semi")
    digest, judged, kept = (fresh(docs, n) for n in ("_digest", "_judged", "_kept"))
    texts = row_signatures(several, width).select("doc_id", "digest").groupBy("doc_id").agg(F.min("digest").alias(judged))
    own = _with_digest(several, width, digest).join(texts, "doc_id").join(signed.select("doc_id", F.col("kept").alias(kept)), "doc_id")
    stay = own.where(F.col(kept) | (F.col(digest) != F.col(judged))).dropDuplicates(["doc_id", digest])
    return out.unionByName(single.select(docs.columns)).unionByName(stay.select(docs.columns))


def _with_digest(docs: DataFrame, width: int, name: str) -> DataFrame:
    def make():
        def apply(texts):
            return [[xxhash.xxh3_128_digest(shingle_hashes(t, width).tobytes()) for t in texts.to_pylist()]]

        return apply

    return add_columns(docs, ["text"], make, [T.StructField(name, T.BinaryType())])

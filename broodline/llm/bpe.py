"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into words (the matches of ``public_tokenizers.PATTERN``, which merges never
cross). A task takes its documents in chunks and numbers the distinct words of a chunk; the
documents become sequences of word numbers, which are the words' positions. Only the
distinct words of a chunk travel, dealt by a hash of the word, so each distinct word of the
whole corpus meets in one task and is encoded once there, however often it occurs: a hot
word is one entry of each chunk. The ids go back to the chunk, where the documents are
reassembled by position. Decoding looks every id up in the token-byte table (the
vocabulary, 50,256 rows) and joins the bytes in order.

One exchange carries both kinds of rows: a chunk's documents under the chunk's key and its
words under the key of their bucket; each reader gets only its own kind. A chunk is named by its place and the digest of its words,
so an input whose rows came in another order on a second read cannot be mixed up with the
first: its words would be missing, which is an error and not a wrong result.

Memory: a task holds one chunk (``CHUNK`` characters, or one longer text), or the distinct
words of one bucket with the rows of one chunk; there are as many buckets as shuffle
partitions. Ids are decoded by the worker that put them together, so a task runs one worker.

Defined results: a null or empty text has no ids. Special strings are ordinary text.
Rows that repeat a doc_id each get their result; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.llm.common import map_batches
from broodline.llm.packing import read_ranks

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 3_000_000  # characters of a chunk
SLICE = 400_000  # words that are expanded together
#: The pattern's white space is Unicode's White_Space, as in the library's own matcher.
_WORDS = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}")
                       .replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+"))


def split_words(text: str | None) -> list[str]:
    return _WORDS.findall(text or "")


def _squeeze(x: np.ndarray) -> bytes:
    """Integers as their size and compressed byte planes."""
    x = np.ascontiguousarray(x, "<u4")
    planes = x.view(np.uint8).reshape(-1, 4).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def _pack(words: list[bytes]) -> bytes:
    lengths = _squeeze(np.fromiter(map(len, words), np.uint32, len(words)))
    body = b"".join(words)
    return (len(lengths).to_bytes(8, "little") + len(body).to_bytes(8, "little") + lengths
            + pa.compress(body, codec="zstd", asbytes=True))


def _unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and the joined items."""
    cut, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    return _unsqueeze(data[16 : 16 + cut]), pa.decompress(data[16 + cut :], size, codec="zstd", asbytes=True)


def _expand(starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The indices of the items ``at``, each being a range of ``lengths`` from ``starts``."""
    n = lengths[at]
    ends = np.cumsum(n)
    return np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _chunk_rows(place: str, ids: list, texts: list[str], buckets: int) -> Iterator[dict]:
    """A chunk's document row and its word rows; ``place`` tells equal chunks apart."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    found = [np.fromiter(map(number.__getitem__, split_words(t)), np.uint32) for t in texts]
    words = [w.encode() for w in number]
    sequence = np.concatenate(found) if found else np.empty(0, np.uint32)
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
    times = np.bincount(sequence, minlength=len(words))
    common = np.argsort(-times, kind="stable")  # frequent words get small numbers
    rank = np.empty(len(words), np.uint32)
    rank[common] = np.arange(len(words))
    order = np.lexsort((rank, bucket))  # by bucket, then frequent words first
    body = _squeeze(rank[sequence])
    key = f"c{place}-{xxhash.xxh3_128_hexdigest(body + b' '.join(words))}"
    yield {"key": key, "ids": ids, "lengths": _squeeze(np.array([len(f) for f in found], np.uint32)),
           "body": body, "slots": _squeeze(rank[order])}
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield {"key": f"b{b}", "chunk": key, "bucket": int(b),
               "body": _pack([words[i] for i in order[ends[b] : ends[b + 1]]])}


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("lengths", T.BinaryType()), T.StructField("slots", T.BinaryType()),
        T.StructField("chunk", T.StringType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("body", T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        ids: list = []
        texts: list[str] = []
        held, chunk = 0, itertools.count()

        def flush():
            place = f"{TaskContext.get().partitionId()}-{next(chunk)}"
            for row in _chunk_rows(place, ids, texts, buckets):
                yield pa.RecordBatch.from_pylist([row], out)

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if ids and held + len(text) > CHUNK:
                    yield from flush()
                    ids, texts, held = [], [], 0
                ids.append(i.as_py())
                texts.append(text)
                held += len(text)
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema).repartition("key")


def _of_kind(dealt: DataFrame, words: bool) -> DataFrame:
    """The word rows, or the document rows. The condition depends on the task, so it is not
    moved below the exchange, which both readers share."""
    bucket = F.when(F.spark_partition_id() >= 0, F.col("bucket"))
    return dealt.where(bucket.isNotNull() if words else bucket.isNull())


def _encoded_words(rows: DataFrame, ranks: str) -> DataFrame:
    """The ids of each chunk's words of a bucket; a bucket's words are encoded once."""

    def run(batches):
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                    mergeable_ranks=read_ranks(ranks), special_tokens={})
        known: dict[bytes, bytes] = {}
        now = None
        for batch in batches:
            chunks, buckets, bodies = (batch.column(n) for n in ("chunk", "bucket", "body"))
            for i in range(batch.num_rows):  # a row at a time: it holds many words
                if (bucket := buckets[i].as_py()) != now:
                    known, now = {}, bucket
                lengths, body = _unpack(bodies[i].as_py())
                ids, at = [], 0
                for n in lengths.tolist():
                    word = body[at : at + n]
                    at += n
                    if (found := known.get(word)) is None:
                        found = np.array(encoder.encode_ordinary(word.decode()), "<u4").tobytes()
                        known[word] = found
                    ids.append(found)
                made = {"key": chunks[i].as_py(), "bucket": now, "body": _pack(ids)}
                yield pa.RecordBatch.from_pylist([made], out)

    out = pa.schema([("key", pa.string()), ("bucket", pa.int32()), ("body", pa.binary())])
    return rows.mapInArrow(run, "key string, bucket int, body binary")


class TokenBytes:
    """The token-byte table: ``decode(ids)`` joins the bytes of ids, little-endian."""

    def __init__(self, ranks: str):
        table = sorted((i, token) for token, i in read_ranks(ranks).items())
        self.lengths = np.zeros(table[-1][0] + 1, np.int64)
        self.lengths[[i for i, _ in table]] = [len(t) for _, t in table]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(t for _, t in table), np.uint8)

    def decode(self, data: bytes) -> bytes:
        x = np.frombuffer(data, "<u4")
        return b"".join(self.flat[_expand(self.starts, self.lengths, x[a : a + SLICE])].tobytes() for a in range(0, len(x), SLICE))


_tables: dict[str, TokenBytes] = {}


def _table(ranks: str) -> TokenBytes:
    """The table of a worker, read once."""
    if ranks not in _tables:
        _tables[ranks] = TokenBytes(ranks)
    return _tables[ranks]


def encode(docs: DataFrame, ranks: str = RANKS, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for each row; ids are unsigned 32-bit integers, little-endian.
    ``decoded``: also the bytes that the ids stand for, from the token-byte table."""
    spark = docs.sparkSession
    dealt = _dealt(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # both readers take all columns, so the exchange is computed and stored once
    words = _encoded_words(_of_kind(dealt, True).sortWithinPartitions("bucket"), ranks)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField("decoded", T.BinaryType())] * decoded)

    def assemble(chunk: pa.Table, parts: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        if not chunk.num_rows:
            return out.empty_table()
        row = {n: chunk.column(n)[0] for n in ("ids", "lengths", "slots", "body")}  # a chunk's name is its own
        parts = parts.sort_by("bucket")
        opened = [_unpack(b.as_py()) for b in parts.column("body")]
        n = np.concatenate([x for x, _ in opened] or [np.empty(0, np.uint32)]).astype(np.int64) // 4
        flat = np.frombuffer(b"".join(x for _, x in opened), "<u4")
        slots = _unsqueeze(row["slots"].as_py())
        if len(n) != len(slots):
            raise RuntimeError("a chunk's words are incomplete: its input gave other rows on a second read")
        length, start = np.empty(len(slots), np.int64), np.empty(len(slots), np.int64)
        length[slots], start[slots] = n, np.cumsum(n) - n
        sequence, ends = _unsqueeze(row["body"].as_py()), np.cumsum(_unsqueeze(row["lengths"].as_py()), dtype=np.int64)
        bodies, first = [], 0
        for end in ends.tolist():
            bodies.append(b"".join(flat[_expand(start, length, sequence[a : min(a + SLICE, end)])].tobytes()
                                   for a in range(first, end, SLICE)))
            first = end
        columns = [pa.array(row["ids"].as_py(), out.field(0).type), pa.array(bodies, pa.binary())]
        if decoded:
            columns.append(pa.array(map(_table(ranks).decode, bodies), pa.binary()))
        made = pa.Table.from_arrays(columns, schema=out)
        del columns, bodies, opened, flat, sequence
        pa.default_memory_pool().release_unused()
        return made

    return _of_kind(dealt, False).groupBy("key").cogroup(words.groupBy("key")).applyInArrow(assemble, schema)


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded``(doc_id, ids) -> (doc_id, ids, decoded): the bytes of the ids."""

    def make():
        def apply(ids, data):
            return [ids, data, [None if d is None else _table(ranks).decode(d) for d in data.to_pylist()]]

        return apply

    return map_batches(encoded.select("doc_id", "ids"), make, T.StructType([
        encoded.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of a round trip."""
    return encode(docs, ranks, decoded=True).select(
        "doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

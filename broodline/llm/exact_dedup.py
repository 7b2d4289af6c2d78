"""Exact deduplication by skew-safe combining of full texts.

Texts are equal when identical after lower-casing A-Z. They are combined in three stages,
each of which groups by the digest and the full text, so that texts meet by their content
and never by a digest alone:

1. local: the partial aggregation of each task leaves one row for each different text it read;
2. salted: those rows are merged within (salt, digest, text), the salt being the reading
   task's number modulo ``SALTS``, so a text that every task holds is merged in ``SALTS`` places;
3. global: at most ``SALTS`` winners of a text are combined.

The group of each document then comes back by its digest. A digest that belongs to several
texts is joined by the text as well; with SHA-256 there is none, and the test has them with a
weak digest. Texts that hold more than one row in 1,000 are fewer than 1,000 and reach their
documents by broadcast, all others by a shuffle of (doc_id, digest), see ``join_by_share``.

Everything is DataFrame functions. Memory: an aggregation spills; a task holds no group but
one row for each of its texts.

Defined results: a null text counts as empty, so null and empty texts are copies of each
other. Very long texts are compared whole. The largest doc_id stays; rows that repeat it
with the same text are one document: all of them are kept and all count in the group's size.
A null doc_id is smaller than any other; only a group of nothing else keeps it. One doc_id
with different texts is in several groups. An empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodline.functions.skew import join_by_share
from broodline.session import stage

SALTS = 16


def normalised(text: str) -> Column:
    """``text`` with A-Z in lower case; null is empty. ``lower`` does that for ASCII texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _groups(texts: DataFrame) -> DataFrame:
    """(digest, text, keep_id, n) of each different text, partitioned by digest."""
    local = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = local.groupBy("salt", "digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.repartition("digest").groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``."""
    texts = docs.select("doc_id", normalised("text").alias("text")).withColumn("digest", digest(F.col("text")))
    found = stage(_groups(texts).groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_texts")))
    total, most = found.agg(F.sum("n"), F.max("n_texts")).first()
    rows = texts.select("doc_id", "digest", (F.col("digest") if digest is sha256 else sha256(F.col("text"))).alias("text_sha256"))
    groups = found.select("digest", "keep_id", F.col("n").alias("group_size"), "n_texts", "n")
    out = join_by_share(rows, groups, "digest", "n", total or 0)
    if (most or 1) > 1:
        shared = found.where("n_texts > 1").select("digest")
        mixed = texts.join(shared, "digest", "left_semi")
        own = _groups(mixed).select("digest", "text", "keep_id", F.col("n").alias("group_size"))
        several = mixed.join(own, ["digest", "text"]).select(
            "doc_id", "digest", sha256(F.col("text")).alias("text_sha256"), "keep_id", "group_size")
        out = out.where("n_texts = 1").drop("n_texts").unionByName(several)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, all columns kept."""
    stay = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = sha256(normalised("text"))
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (sha == F.col("_sha")), "left_semi")

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from broodline.llm import exact_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def rows_with_copies(texts):
    rows = list(texts.items())
    rows += [(100 + i, "Hot COPY É") for i in range(300)] + [(7, "same id, other text"), (None, "no id"), (None, None), (None, "no id")]
    rows += [(500, "É upper"), (501, "é upper"), (502, "É UPPER"), (503, "x" * 1_000_000), (504, "X" * 1_000_000),
             (100, "Hot COPY É")]  # a repeated row
    return rows


def test_equals_brute_force(spark, texts):
    rows = rows_with_copies(texts)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == brute(rows)


def test_a_weak_digest_does_not_join_different_texts(spark, texts):
    rows = rows_with_copies(texts)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weak = lambda t: (F.length(t) % 3).cast("string")
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(df, weak).collect()), key=str)
    assert got == brute(rows)


def test_rows_that_stay(spark, docs, empty, clashing):
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns
    found = {r.doc_id for r in exact_dedup.exact_groups(docs).where("kept").collect()}
    assert {r.doc_id for r in stay.collect()} == found
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0
    assert sorted(exact_dedup.exact_groups(clashing).collect(), key=str) == sorted(exact_dedup.exact_groups(docs).collect(), key=str)


def test_no_python_and_no_window(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Window|Nested|Cartesian", plan)


def test_hot_text_is_merged_by_salt(spark):
    """Every task holds the text: the salted stage has SALTS rows of it, not one for each task."""
    df = spark.range(4000).selectExpr("id as doc_id", "'same' as text").repartition(64)
    texts = df.select("doc_id", exact_dedup.normalised("text").alias("text")).withColumn("digest", exact_dedup.sha256(F.col("text")))
    salts = texts.select(F.pmod(F.spark_partition_id(), F.lit(exact_dedup.SALTS)).alias("salt")).distinct().count()
    assert salts == exact_dedup.SALTS
    assert exact_dedup.exact_groups(df).where("kept").collect()[0][:3] == (3999, 3999, 4000)

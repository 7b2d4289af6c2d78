"""The corpus pipeline over ``documents``: language, toxicity, near copies, personal data,
packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet
into the shared checkpoint folder and reads again as the next stage's docs. All stages but
the last return the columns of documents. What a stage needs beyond its docs it learns
from them (language profiles, span labelers) or from the labels of ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodline.llm import language_id, minhash, packing, pii, toxicity
from broodline.llm.common import fresh
from broodline.session import ensure_checkpoint_dir


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without any language (null or no letter) and texts that resemble none of
    the learned languages (largest cosine within the noise). Texts with too few trigrams to
    tell stay."""
    profiles = language_id.train_on_documents(docs)
    lang, score, size = fresh(docs, "lang_pred"), fresh(docs, "score"), fresh(docs, "n_trigrams")
    found = language_id.identify(docs, profiles, lang, score, size)
    known = (F.col(score) > language_id.NOISE) | (F.col(size) < language_id.ENOUGH)
    return found.where((F.col(lang) != language_id.UNKNOWN) & known).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose chance of toxicity is at least ``toxicity.LIMIT``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more)."""
    return minhash.deduplicated(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; ``n_chars`` follows the text."""
    return pii.mask(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The learned and packed stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all of ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

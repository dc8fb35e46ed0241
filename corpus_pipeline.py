"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept:
quality filter, near-duplicates, redaction, source mixing, packing. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.mixing import mix_sources
from veilspark.llm.neardup import near_duplicates
from veilspark.llm.packing import pack
from veilspark.llm.pii import redact
from veilspark.llm.quality import keep_good, learn
from veilspark.llm.work import drop, keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Its labels' training fold is what it learns from.
    Null and empty texts are judged as texts without features; repeated rows are judged alike; no documents give none."""
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels"))).select(COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. Rows that share a doc_id go or stay
    together; texts without words and rows without a doc_id stay; no documents give none."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by [KIND]; n_chars follows the new text. A null text stays null, as does its n_chars."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights. The budget gives every source a whole epoch, so no document is lost; small sources repeat.
    Null sources are one source, repeated rows stay, an empty table stays empty."""
    return mix_sources(docs, columns=["text", "lang", "n_chars"]).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens. Null and empty texts are one end mark each; repeated rows are packed as they come."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("personal_data", private), ("mixing", mixture), ("packing", packing)]

#: A trained model, MinHash candidates and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name)
            if i:
                drop(before)
    return docs

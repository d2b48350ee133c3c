"""Corpus pipeline: language id, exact dedup, near dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents; with several epochs a document
that mixing takes k times is k rows. A stage handles nulls, repeated rows and empty input as its operator
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import bottomk, bpe, exact, langid, mixing, queries
from corvine.llm.textkit import remove, scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Mean probability from which a predicted language replaces a given one. On sf0.1 the ten that differ score less.
SURE = 0.9
#: Tokens after mixing, as a share of those before it, and whole epochs of a leaf at most.
MIX_SHARE = 0.9
MIX_EPOCHS = 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows and drops the documents in no language (`und`): those without a letter. The
    prediction takes the place of a NULL lang, and of another one where its score is SURE or more. Where no
    language could be learned, lang stays."""
    docs = docs.select(*COLUMNS)
    scorer = langid.train(docs.select("doc_id", "text", "lang"))
    if not set(scorer.labels) - {langid.UNKNOWN}:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    sure = F.col("score") >= (SURE if len(scorer.labels) > 1 else 2)
    return langid.identify(docs, scorer).where(F.col("lang_pred") != langid.UNKNOWN).select(
        "doc_id",
        "text",
        F.when(F.col("lang").isNull() | sure, F.col("lang_pred")).otherwise(F.col("lang")).alias("lang"),
        "source",
        "n_chars",
    )


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact.drop_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group with five-word shingles at a Jaccard likeness of 0.8 or more, the smallest doc_id stays."""
    docs = docs.select(*COLUMNS)
    groups = bottomk.group_near_copies(docs, num=80, den=100)
    kept = groups.where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their share of the token budget, one row for each epoch that takes them."""
    docs = docs.select(*COLUMNS)
    plan = mixing.plan_copies(
        docs.withColumn("domain", mixing.domain_of()), queries.MIX_WEIGHTS, MIX_SHARE, max_epochs=MIX_EPOCHS
    )
    taken = plan.where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    return (
        docs.join(taken.withColumnRenamed("doc_id", "taken_id"), F.col("doc_id").eqNullSafe(F.col("taken_id")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select(*COLUMNS)
    )


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text: doc_id, n_tokens, ids, round_trip."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = bpe.tokenise(texts, queries.vocabulary(), keep_text=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokenise", tokenise),
]

#: Learning, near-duplicate search and tokenising have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        if 0 < k < len(STAGES) - 1:
            remove(spark, f"{folder}/{k - 1}")
    return docs

"""Keeps a keyword index of documents as files with new or changed documents arrive.

    python -m jobs.index_documents --documents IN --output OUT --checkpoint CKPT [--config FILE]

The files of IN (Parquet: doc_id, text, lang, source) are a stream; a run takes the files that no earlier run has taken
and ends. A document that arrives again replaces its earlier version; one that arrives unchanged adds nothing. OUT
holds three tables, each partitioned by the batch that wrote it:

* documents: doc_id, digest (SHA-256 of the text), lang, source, n_tokens, of each version;
* postings: bucket (a second partition, by hash of the term), term, doc_id, tf, held: how often each term stands in a
  version, and whether its words hold it (document frequencies go by that);
* totals: lang, source, n_documents, n_tokens: what the batch changes in these sums. Sums over all batches are those
  of the current versions, so statistics of a search need no pass over documents.

A batch reads earlier batches alone and replaces its own partitions, so one that is repeated after a failure gives the
same; the stream's checkpoint holds which files are done. Of rows with one doc_id in a batch, the one with the
greatest digest, lang and source counts. Rows without a doc_id are counted and left out; a NULL text is empty.
"""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as X
from corvine.operators.postings import run_counts, term_runs
from jobs.common import LOG, command

ABOUT = "Keeps a keyword index of documents as files arrive."
PATHS = {"documents": "folder of document files, or a pattern", "output": "folder of the index", "checkpoint": "folder of the stream's checkpoint"}
INPUT = "doc_id bigint, text string, lang string, source string"
SCHEMAS = {
    "documents": "doc_id bigint, digest string, lang string, source string, n_tokens bigint, batch bigint",
    "postings": "term string, doc_id bigint, tf int, held boolean, batch bigint, bucket int",
    "totals": "lang string, source string, n_documents bigint, n_tokens bigint, batch bigint",
}


def read(spark: SparkSession, output: str, table: str) -> DataFrame:
    """A table of the index; without rows as long as no batch has written it."""
    try:
        return spark.read.schema(SCHEMAS[table]).parquet(f"{output}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[table])


def newest(documents: DataFrame) -> DataFrame:
    """The current version of each document, with its batch."""
    own = [c for c in documents.columns if c != "doc_id"]
    return documents.groupBy("doc_id").agg(F.max_by(F.struct(*own), "batch").alias("x")).select("doc_id", *[f"x.{c}" for c in own])


def current_postings(spark: SparkSession, output: str) -> DataFrame:
    """The index as it stands: doc_id, lang, source, n_tokens of the document, term, tf, held."""
    now = newest(read(spark, output, "documents")).drop("digest")
    lists = read(spark, output, "postings").drop("bucket")
    return now.join(lists, ["doc_id", "batch"]).drop("batch")


def current_totals(spark: SparkSession, output: str) -> DataFrame:
    """Documents and tokens by language and source."""
    sums = [F.sum(c).alias(c) for c in ("n_documents", "n_tokens")]
    return read(spark, output, "totals").groupBy("lang", "source").agg(*sums).where("n_documents > 0")


def _put(rows: DataFrame, output: str, table: str, *partitions: str) -> None:
    """Replaces the partitions that rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{output}/{table}")


def _changed(batch: DataFrame, earlier: DataFrame) -> DataFrame:
    """The versions that the batch brings: documents that are new or differ from their newest version in earlier."""
    version = ["digest", "lang", "source"]
    rows = batch.select("doc_id", F.sha2("text", 256).alias("digest"), "lang", "source", F.size(X.tokens("text")).cast("bigint").alias("n_tokens"))
    arrived = rows.groupBy("doc_id").agg(F.max(F.struct(*version, "n_tokens")).alias("x")).select("doc_id", "x.*")
    held = newest(earlier).select("doc_id", F.struct(*version).alias("held"))
    return arrived.join(held, "doc_id", "left").where(~F.struct(*version).eqNullSafe(F.col("held"))).drop("held")


def _postings(texts: DataFrame, buckets: int) -> DataFrame:
    """Postings of texts by bucket of their term; a bucket is dealt over several tasks, as one term may be in most texts."""
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), X.SEPARATORS), ""))
    runs = texts.select("doc_id", F.explode(term_runs(X.tokens("text"), words)).alias("run"))
    rows = runs.select("doc_id", *run_counts(F.col("run")))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, tasks // buckets)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition(max(tasks, buckets), "bucket", part)
    return dealt.sortWithinPartitions("bucket", "term", "doc_id")


def index_batch(batch: DataFrame, number: int, output: str, buckets: int) -> dict[str, int]:
    """One batch of documents into the index; how many rows were read and written."""
    spark, at = batch.sparkSession, F.lit(number).cast("bigint").alias("batch")
    counts = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("without_id")).first().asDict()
    texts = batch.where("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    before = F.col("batch") < number
    _put(_changed(texts, read(spark, output, "documents").where(before)).select("*", at), output, "documents", "batch")
    stored = read(spark, output, "documents")  # what the following steps read is stored, and not made again
    new = stored.where(F.col("batch") == number)
    counts["versions"] = new.count()
    if counts["versions"] < counts["rows"] - counts["without_id"]:  # not every row is a new version
        own = new.select("doc_id", "digest", F.struct("lang", "source").alias("__rest"))
        named = texts.withColumns({"digest": F.sha2("text", 256), "__rest": F.struct("lang", "source")})
        same = (named["doc_id"] == own["doc_id"]) & (named["digest"] == own["digest"]) & named["__rest"].eqNullSafe(own["__rest"])
        texts = named.join(own, same, "left_semi").dropDuplicates(["doc_id"])
    _put(_postings(texts, buckets).select("*", at), output, "postings", "batch", "bucket")
    replaced = newest(stored.where(before).join(new.select("doc_id"), "doc_id", "left_semi"))
    sums = new.select("lang", "source", F.lit(1).alias("k"), "n_tokens").unionByName(replaced.select("lang", "source", F.lit(-1).alias("k"), "n_tokens"))
    totals = sums.groupBy("lang", "source").agg(F.sum("k").alias("n_documents"), F.sum(F.col("k") * F.col("n_tokens")).alias("n_tokens"))
    _put(totals.select("*", at), output, "totals", "batch")
    counts["replaced"] = counts["versions"] - (read(spark, output, "totals").where(F.col("batch") == number).agg(F.sum("n_documents")).first()[0] or 0)
    counts["postings"] = read(spark, output, "postings").where(F.col("batch") == number).count()
    return counts


def index_documents(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> list[dict[str, int]]:
    """Takes what is new in documents into the index; a report of each batch."""
    reports = []

    def run(batch: DataFrame, number: int) -> None:
        report = {"batch": number} | index_batch(batch, number, output, config["buckets"])
        LOG.info("read from %s and written to %s: %s", documents, output, report)
        reports.append(report)

    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not reports:
        LOG.info("nothing new in %s", documents)
    return reports


def main(argv: list[str] | None = None) -> int:
    return command(
        "index_documents", ABOUT, PATHS, lambda spark, a, config: index_documents(spark, a.documents, a.output, a.checkpoint, config), argv
    )


if __name__ == "__main__":
    sys.exit(main())

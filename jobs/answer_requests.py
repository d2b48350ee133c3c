"""Answers a table of search requests over a table of documents.

    python -m jobs.answer_requests --documents IN --requests REQ --output OUT [--config FILE]

IN is Parquet with doc_id, text, lang, source; REQ is Parquet with item_id and text, the words to look for, and perhaps
lang (a list with commas), path (a part of a source) and limit, which otherwise is the config's. Posting lists of
the documents go to OUT/lists, and the results of all requests, made of the lists of their terms or, where these are
many, in two passes over the documents' rows there, to OUT/results: item_id, ordinal (from 1), doc_id, source, score, partitioned by a hash of item_id. At most three
results of a request are from one source. Both folders are replaced as a whole, so another run over the same
input gives the same.

Documents and requests with a NULL id are counted and left out. Of documents of one source that share a doc_id the
best is a result; of requests that share an item_id, the one with the greatest text, lang, path and limit is asked.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators.postings import Postings
from jobs.common import LOG, command

ABOUT = "Answers a table of search requests over a table of documents."
PATHS = {"documents": "Parquet with documents", "requests": "Parquet with requests", "output": "folder of lists and results"}


def blocks_of(documents: DataFrame) -> DataFrame:
    """Documents as blocks for keyword search: one in the file of its source, named and placed by its doc_id."""
    none = F.lit(None).cast("string")
    return documents.where("doc_id IS NOT NULL").select(
        F.coalesce("source", F.lit("")).alias("file_path"),
        F.col("doc_id").alias("start_line"),
        F.col("doc_id").alias("end_line"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.col("lang").alias("language"),
        F.lit("Other").alias("kind"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        none.alias("parent"),
        none.alias("signature"),
        F.array().cast("array<string>").alias("annotations"),
    )


def requests_of(rows: DataFrame, limit: int) -> DataFrame:
    """Request rows as the search takes them; a request is numbered by its item_id."""
    given = lambda c, kind, other: (F.coalesce(F.col(c).cast(kind), other) if c in rows.columns else other).alias(c)
    asked = F.struct(
        F.coalesce("text", F.lit("")).alias("query"),
        given("lang", "string", F.lit(None).cast("string")),
        given("path", "string", F.lit(None).cast("string")),
        given("limit", "int", F.lit(limit)),
    )
    one = rows.where("item_id IS NOT NULL").groupBy(F.col("item_id").alias("request")).agg(F.max(asked).alias("asked"))
    return one.select("request", "asked.*")


def answer_requests(spark: SparkSession, documents: str, requests: str, output: str, config: dict) -> dict[str, int]:
    docs, asked = spark.read.parquet(documents), spark.read.parquet(requests)
    counts = {}
    for name, rows, key in (("documents", docs, "doc_id"), ("requests", asked, "item_id")):
        counts |= rows.agg(F.count(F.lit(1)).alias(name), F.count_if(F.col(key).isNull()).alias(f"{name}_without_id")).first().asDict()
    lists = Postings(spark, f"{output}/lists")
    lists.write(blocks_of(docs), config["buckets"])
    found = lists.search(requests_of(asked, config["limit"])).select(
        F.col("request").alias("item_id"),
        "ordinal",
        F.substring_index("name", "_", -1).cast("bigint").alias("doc_id"),
        F.col("file_path").alias("source"),
        "score",
    )
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(config["result_buckets"])).cast("int").alias("bucket")
    rows = found.select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", "item_id", "ordinal")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{output}/results")
    counts["results"] = results(spark, output).count()
    LOG.info("read from %s and %s, written to %s: %s", documents, requests, output, counts)
    return counts


def results(spark: SparkSession, output: str) -> DataFrame:
    shape = "item_id bigint, ordinal bigint, doc_id bigint, source string, score double, bucket int"
    return spark.read.schema(shape).parquet(f"{output}/results").drop("bucket")


def main(argv: list[str] | None = None) -> int:
    return command("answer_requests", ABOUT, PATHS, lambda spark, a, config: answer_requests(spark, a.documents, a.requests, a.output, config), argv)


if __name__ == "__main__":
    sys.exit(main())

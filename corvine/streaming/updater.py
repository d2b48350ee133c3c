"""Changes into an index, batch by batch."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from corvine.plans.index import Index
from corvine.sources.scan import read_files
from corvine.streaming.changes import TreeChanges

LOG = logging.getLogger(__name__)
#: Changed files of one batch at most.
FILES_PER_BATCH = 10_000


def newest(changes: DataFrame, order: str = "seq") -> DataFrame:
    """The last change of each path: path, op and, where changes have it, content; also its order, as seq, where
    that is a number."""
    held = [c for c in ("op", "content") if c in changes.columns]
    if isinstance(changes.schema[order].dataType, NumericType):
        held.append(order)
    last = F.max_by(F.struct(*held), order).alias("x")
    return changes.where(F.col("op").isin("upsert", "remove")).groupBy("path").agg(last).select("path", *[F.col(f"x.{c}").alias("seq" if c == order else c) for c in held])


def with_content(changes: DataFrame) -> DataFrame:
    """Changes that carry contents as they are, with their seq: a log, whose order the index keeps. Else the
    contents of the changed files as they are now, read by the tasks; a file that is gone is a removal."""
    if "content" in changes.columns:
        return changes
    found = read_files(changes.sparkSession, changes.where("op = 'upsert'").select("path"))
    gone = F.when(F.col("content").isNull(), "remove").otherwise("upsert")
    removed = changes.where("op = 'remove'").select("path", "op", F.lit(None).cast("binary").alias("content"))
    return found.select("path", gone.alias("op"), "content").unionByName(removed)


def apply_batch(index: Index):
    """Body for foreachBatch. Applying a batch twice gives the same index, so a restart is safe; changes of a log may
    be spread over batches in any order. Each batch logs what the index did with it."""

    def run(batch: DataFrame, number: int) -> None:
        LOG.info("batch %d into %s: %s", number, index.root, index.apply(with_content(newest(batch))))

    return run


def follow(spark: SparkSession, root: str, index: Index, checkpoint: str, once: bool = False, seconds: int = 2):
    """Starts a query that keeps the index as the tree is; with once, it ends after what is there now, in one
    batch."""
    spark.dataSource.register(TreeChanges)
    stream = spark.readStream.format("tree_changes").option("path", root)
    if not once:
        stream = stream.option("maxFilesPerTrigger", str(FILES_PER_BATCH))
    writer = stream.load().writeStream.foreachBatch(apply_batch(index)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()

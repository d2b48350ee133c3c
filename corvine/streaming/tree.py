"""Changes of a tree that only tasks list: snapshots as tables, their differences as files for a stream.

`publish` lists the tree (sources.listing) as the next snapshot and writes what differs from the one before, by a full
outer join, as Parquet that a file stream follows:

    STATE/snapshots/version=N     path, size, modified
    STATE/changes/version=N       path, op ('upsert' or 'remove'), seq (N)

A snapshot counts once its write has succeeded. Differences follow from two snapshots, so those of a run that ended
in between are written by the next one. No list of paths reaches the driver. One process publishes a state at a time.
`update` publishes, and takes what is new into an index through a stream with a checkpoint; run it at intervals, or
let `keep_updating` do so.
"""

from __future__ import annotations

import logging
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.plans.index import Index
from corvine.sources.listing import list_tree
from corvine.streaming.updater import FILES_PER_BATCH, apply_batch

SNAPSHOT = "path string, size bigint, modified bigint"
CHANGES = "path string, op string, seq bigint"
#: Files of changes that one batch takes.
FILES_AT_ONCE = 64
LOG = logging.getLogger(__name__)


def _done(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose write has succeeded."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in store.listStatus(path)] if store.exists(path) else []
    whole = [p.getName() for p in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in whole if n.startswith("version="))


def _snapshot(spark: SparkSession, state: str, version: int) -> DataFrame:
    if not version:
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(f"{state}/snapshots/version={version}")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and op of what differs between two snapshots."""
    before, after = (df.select("path", F.struct("size", "modified").alias(name)) for df, name in ((old, "before"), (new, "after")))
    both = before.join(after, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select("path", F.when(F.col("after").isNull(), "remove").otherwise("upsert").alias("op"))


def _publish_changes(spark: SparkSession, state: str, version: int) -> None:
    rows = difference(_snapshot(spark, state, version - 1), _snapshot(spark, state, version)).select("*", F.lit(version).cast("bigint").alias("seq"))
    # a version of any size is taken in batches of bounded size
    rows.write.mode("overwrite").option("maxRecordsPerFile", FILES_PER_BATCH).parquet(f"{state}/changes/version={version}")


def publish(spark: SparkSession, root: str, state: str, **options: str) -> int | None:
    """The next version of the tree, if it differs from the last one: its number. options: of list_tree."""
    known = _done(spark, f"{state}/snapshots")
    last = known[-1] if known else 0
    if last and last not in _done(spark, f"{state}/changes")[-1:]:  # a run that ended in between
        _publish_changes(spark, state, last)
    version = last + 1
    folder = f"{state}/snapshots/version={version}"
    list_tree(spark, root, **options).select("path", "size", "modified").write.mode("overwrite").parquet(folder)
    if not difference(_snapshot(spark, state, last), _snapshot(spark, state, version)).limit(1).count():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return None
    _publish_changes(spark, state, version)
    return version


def update(spark: SparkSession, root: str, index: Index, state: str, **options: str) -> int | None:
    """Brings the index to where the tree is now; the version that was published, if any."""
    version = publish(spark, root, state, **options)
    if not _done(spark, f"{state}/changes"):
        return None
    stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", FILES_AT_ONCE).parquet(f"{state}/changes")
    body = apply_batch(index)
    query = stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return version


def keep_updating(spark: SparkSession, root: str, index: Index, state: str, stop: threading.Event, seconds: float = 2, **options: str) -> None:
    """update at intervals until stop is set; one that fails is made up for by the next."""
    while not stop.is_set():
        try:
            version = update(spark, root, index, state, **options)
            if version:
                LOG.info("%s: version %d", root, version)
        except Exception:
            LOG.exception("update of %s", root)
        stop.wait(seconds)

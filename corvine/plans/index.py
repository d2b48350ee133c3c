"""Index tables: building from files, and updates by path.

blocks, files and vectors are kept in buckets by a hash of the path; a new index gets a bucket for every
BUCKET_BYTES of its files, and a bucket is written by several tasks. An update writes new versions of the
buckets it touches and then one commit (see snapshots); readers use the newest commit, one small file, so a search
never waits for an update and an update never rewrites the whole index. Writers write versions of their own; one
that finds its buckets changed since it read them raises ConcurrentUpdate and commits nothing. vacuum() removes
versions that are no longer in use.

Changes may carry their place in a log, seq. The index then keeps the seq of every path, also of removed ones, and
takes only changes that come after it, so batches of a log may arrive in any order and more than once.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.functions.text import document_text, embedding_text, tokens
from corvine.operators import postings as P
from corvine.plans.embedders import Embedder, embed_texts
from corvine.plans.snapshots import ConcurrentUpdate, Log, Snapshot  # noqa: F401  raised by writes
from corvine.schema import BLOCK, INDEXED, VECTOR

#: Buckets at least, and bytes of files for each in a new index.
BUCKETS = 32
BUCKET_BYTES = 256 << 20


#: What a write reports.
DONE = ("parsed", "failed", "removed", "blocks")
#: Wide enough for a 64-bit number, or for a time in microseconds before another number.
SEQ = "decimal(38,0)"
#: Tables of an index that keeps posting lists.
_LISTS = {"postings": P.POSTING, "sizes": P.SIZE, "grams": P.GRAM}
_FILE_STATE = f"path string, error string, n_blocks int, seq {SEQ}, removed boolean"


def parse_files(files: DataFrame) -> DataFrame:
    """files: path, content. One row a file: path, error, blocks (array). A row that is `removed`, where files say so,
    is not parsed, and a column seq stays."""
    extra = [c for c in ("seq", "removed") if c in files.columns]
    own = [T.StructField("path", T.StringType()), T.StructField("error", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK))]
    schema = T.StructType([*own, *[files.schema[c] for c in extra]])

    def run(batches):
        import pandas as pd

        from corvine.sources.parsers import parse_file

        for pdf in batches:
            gone = pdf["removed"] if "removed" in extra else [False] * len(pdf)
            rows = zip(pdf["path"], pdf["content"], gone, strict=True)
            found = [([], None) if g else parse_file(p, None if c is None else bytes(c)) for p, c, g in rows]
            out = {"path": pdf["path"], "error": [e for _, e in found], "blocks": [b for b, _ in found]}
            yield pd.DataFrame(out | {c: pdf[c] for c in extra})

    return files.select("path", "content", *extra).mapInPandas(run, schema)


def register_blocks_function(spark: SparkSession, name: str = "code_blocks") -> None:
    """SELECT * FROM code_blocks(path, content): the blocks of one file, as a table function for SQL. A file
    that does not parse gives no row."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=BLOCK)
    class CodeBlocks:
        def eval(self, path: str, content: bytes):
            from corvine.sources.parsers import parse_file

            for row in parse_file(path, None if content is None else bytes(content))[0]:
                yield tuple(row[f.name] for f in BLOCK.fields)

    spark.udtf.register(name, CodeBlocks)


def blocks_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").select(F.explode("blocks").alias("b")).select("b.*")


def counts(parsed: DataFrame) -> DataFrame:
    """Files that parsed and failed, and blocks."""
    return parsed.groupBy(F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("status")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("blocks")), F.lit(0)).cast("bigint").alias("blocks")
    )


def embed_blocks(blocks: DataFrame, embedder: Embedder) -> DataFrame:
    """A vector for each block key; of blocks that share one, the last by kind and name."""
    rows = blocks.select("file_path", "start_line", "end_line", "kind", "name", embedding_text().alias("text"))
    last = rows.groupBy("file_path", "start_line", "end_line").agg(F.max_by("text", F.struct("kind", "name")).alias("text"))
    return embed_texts(last, embedder)


def _has_lists(now: Snapshot) -> bool:
    return any(t == "postings" for t, _ in now.versions)


def _bucket(path: str, number: int):
    return F.pmod(F.xxhash64(path), F.lit(number)).cast("int")


def _plain(files: DataFrame) -> DataFrame:
    return files.select("path", "content", F.lit(None).cast(SEQ).alias("seq"), F.lit(False).alias("removed"))


class Index:
    """A versioned index in a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, buckets: int | None = None, postings: bool = False) -> None:
        """buckets: their number in a new index, by its size if not given; an index that is there has its own.
        postings: also keep posting lists and the sums that statistics are made of, by file and brought up to date
        with every commit; keyword searches then read the lists of their terms and no texts. An index that was built
        with them keeps them, whoever writes to it."""
        self.spark, self.root, self.embedder, self._wanted = spark, root.rstrip("/"), embedder, buckets
        self._log, self.postings = Log(spark, self.root), postings

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @property
    def buckets(self) -> int:
        """The number that the index was built with."""
        return self._log.newest().buckets or self._wanted or BUCKETS

    def snapshot(self) -> Snapshot:
        """The newest commit; reads that share one see one state."""
        return self._log.newest()

    def vacuum(self, seconds: float = 7 * 86_400) -> list[str]:
        """Removes versions that no commit of the last `seconds` uses: their folders."""
        return self._log.vacuum(["blocks", "files", "vectors", *_LISTS], seconds)

    def _read(self, table: str, schema, buckets: list[int] | None = None, now: Snapshot | None = None) -> DataFrame:
        """A table as committed now, or at another time. The versions in use are listed, and the buckets that each
        one holds the newest data of are chosen by partition filters."""
        now = self.snapshot() if now is None else now
        by: dict[int, list[int]] = {}
        for (t, b), v in now.versions.items():
            if t == table and (buckets is None or b in buckets):
                by.setdefault(v, []).append(b)
        if not by:
            return self.spark.createDataFrame([], schema)
        columns = [f.name for f in T.StructType.fromDDL(schema)] if isinstance(schema, str) else schema.names
        full = (T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema))).add("v", T.LongType()).add("bucket", T.IntegerType())
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/v={v}" for v in sorted(by)])
        parts = [(F.col("v") == v) & F.col("bucket").isin(own) for v, own in sorted(by.items())]
        return rows.where(functools.reduce(lambda x, y: x | y, parts)).select(*columns)

    def blocks(self, now: Snapshot | None = None) -> DataFrame:
        return self._read("blocks", INDEXED, now=now)

    def vectors(self, now: Snapshot | None = None) -> DataFrame:
        return self._read("vectors", VECTOR, now=now)

    def lists(self, now: Snapshot | None = None) -> P.Lists:
        """The posting lists, of an index that was built with them."""
        now = self.snapshot() if now is None else now
        return P.Lists(*[self._read(name, schema, now=now) for name, schema in _LISTS.items()])

    def files(self) -> DataFrame:
        """path, error, n_blocks, seq of the files that are there."""
        return self._read("files", _FILE_STATE).where("NOT coalesce(removed, false)").drop("removed")

    def build(self, files: DataFrame) -> dict[str, int]:
        """A new index of these files alone; files that fail are recorded with their error. What was done: parsed,
        failed, removed files and blocks."""
        number = self._wanted
        if number is None:
            size = files.agg(F.sum(F.octet_length("content")).alias("b")).first()["b"] or 0
            number = max(BUCKETS, -(-size // BUCKET_BYTES))
        return self._write(parse_files(_plain(files)), list(range(number)), Snapshot(buckets=number), whole=True)

    def apply(self, changes: DataFrame) -> dict[str, int]:
        """changes: path, op ('upsert' or 'remove'), content; one row a path. A file that does not parse keeps
        its old rows; one that parses to nothing loses them. With a column seq, a number, only changes above the
        one that the index holds of their path are taken, and a removal keeps its own; without, all are, and the
        index's seq stays. What was done, as from build."""
        ordered = "seq" in changes.columns
        seq = F.col("seq") if ordered else F.lit(None)
        changes = changes.select("path", "content", seq.cast(SEQ).alias("seq"), (F.col("op") == "remove").alias("removed"))
        seen = self.snapshot()
        number = seen.buckets or self.buckets
        touched = [r["bucket"] for r in changes.select(_bucket("path", number).alias("bucket")).distinct().collect()]
        if not touched:
            return dict.fromkeys(DONE, 0)
        held = self._read("files", _FILE_STATE, touched, seen).select(F.col("path").alias("__path"), F.col("seq").alias("__seq"))
        met = changes.join(held, changes["path"] == held["__path"], "left")
        if ordered:
            met = met.where(F.col("__seq").isNull() | (F.col("seq") > F.col("__seq")))
        return self._write(parse_files(met.select("path", "content", F.coalesce("seq", "__seq").alias("seq"), "removed")), touched, seen)

    @property
    def stream(self) -> str:
        """The checkpoint of the stream that keeps this index."""
        return f"{self.root}/stream"

    def followed(self) -> bool:
        """Whether the index is one that its stream can go on with."""
        path, store = self._path("stream/offsets")
        return self.snapshot().number > 0 and store.exists(path)

    def clear(self) -> None:
        """An empty index, whose stream begins anew."""
        path, store = self._path("stream")
        store.delete(path, True)
        self._log.commit(self.snapshot(), {}, self.buckets, whole=True)

    def _dealt(self, rows: DataFrame, key: str, touched: int, number: int) -> DataFrame:
        """Rows by bucket, each bucket over as many tasks as the shuffle partitions allow."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = max(1, tasks // max(touched, 1))
        part = F.pmod(F.xxhash64(key, F.lit("part")), F.lit(spread))
        return rows.withColumn("bucket", _bucket(key, number)).repartition(max(tasks, touched), F.col("bucket"), part)

    def _write(self, parsed: DataFrame, touched: list[int], seen: Snapshot, whole: bool = False) -> dict[str, int]:
        """parsed: what parse_files gives, with seq and removed. seen: the commit that it was made after. whole: the
        index is then this alone."""
        version, number = uuid.uuid4().int >> 66, seen.buckets or self.buckets
        stage = f"{self.root}/parsed/v={version}"
        done = Observation()  # counted by the tasks that parse, in the one pass over the files
        good, gone = F.col("error").isNull(), F.col("removed")
        said = [F.count_if(good & ~gone), F.count_if(~good), F.count_if(gone), F.coalesce(F.sum(F.when(good, F.size("blocks"))), F.lit(0))]
        counted = parsed.observe(done, *[c.cast("bigint").alias(n) for n, c in zip(DONE, said, strict=True)])
        counted.write.mode("overwrite").parquet(stage)  # parsed once, read for every table
        parsed = self.spark.read.schema(parsed.schema).parquet(stage)
        good = parsed.where("error IS NULL")  # removed files among them, which have no blocks
        blocks = blocks_of(good)
        n_blocks = F.when(F.col("error").isNull(), F.size("blocks")).cast("int").alias("n_blocks")
        # a removal without a place in a log leaves nothing
        state = parsed.where("NOT (removed AND seq IS NULL)").select("path", "error", n_blocks, "seq", "removed")
        stored = blocks.withColumn("tokens", tokens(document_text()))
        tables = {"blocks": (stored, INDEXED, "file_path"), "files": (state, _FILE_STATE, "path")}
        if self.embedder is not None:
            tables["vectors"] = (embed_blocks(blocks, self.embedder), VECTOR, "file_path")
        lists = self.postings if whole or not seen.versions else _has_lists(seen)
        if lists:
            tables |= {"postings": (P.postings(stored), P.POSTING, "file_path"), "sizes": (P.sizes_of(stored), P.SIZE, "file_path")}
        of = set(touched)
        for name, (new, schema, key) in tables.items():
            if any(t == name and b in of for t, b in seen.versions):
                gone = (parsed if name == "files" else good).select(F.col("path").alias("__gone"))
                old = self._read(name, schema, touched, seen)
                new = old.join(gone, old[key] == gone["__gone"], "left_anti").unionByName(new)
            dealt = self._dealt(new, key, len(touched), number)
            if name == "postings":
                dealt = dealt.sortWithinPartitions("bucket", "term")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/v={version}")
        if lists:  # what the buckets hold now, so that a word goes with its last file
            rows = self.spark.read.schema(f"{P.POSTING}, bucket int").parquet(f"{self.root}/postings/v={version}")
            grams = P.gram_rows(rows, "bucket").sortWithinPartitions("bucket", "gram")
            grams.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/grams/v={version}")
            tables |= {"grams": (grams, P.GRAM, "word")}
        path, store = self._path(f"parsed/v={version}")
        store.delete(path, True)  # not read again
        self._log.commit(seen, {(t, b): version for t in tables for b in touched}, number, whole)
        return {n: done.get[n] for n in DONE}

    def engine(self):
        from corvine.plans.engine import Engine

        embed = None if self.embedder is None else (lambda text: self.embedder.embed([text])[0])
        now = self.snapshot()
        lists = self.lists(now) if _has_lists(now) else None
        return Engine(self.blocks(now), None if self.embedder is None else self.vectors(now), embed, lists)

"""Operator 4: exact deduplication by skew-safe combining, with DataFrame functions only.

Three combining stages, each grouping by the full content beside its digest, so that equal digests
of different texts never merge:

1. local: the partial aggregate of stage 2 runs in every map task before the shuffle and leaves one
   row for each different text (and salt) that the task has seen;
2. salted: rows meet by (digest, salt, text), where the salt is a hash of the doc_id; a text that a
   third of the corpus repeats is spread over as many salts as there are shuffle partitions;
3. global: the salt winners of a text, at most one for each salt, meet by (digest, text); this too
   has a partial aggregate before its shuffle.

The result returns to the documents without their texts, by (digest, second hash, salt): 320 bits; the rows of
a hot text stay spread over the salts. The salt is a hash of doc_id and, where that is NULL, of the other given
columns, so that rows without an id are spread, too.

Cases: NULL text counts as empty. Of equal texts the largest doc_id stays; a NULL doc_id is smaller than any
other, so it stays where no row of the group has one. mark_copies reports rows that repeat both doc_id and
text as kept alike; drop_copies keeps one of them. An empty table gives an empty result. Extra columns are
ignored, and drop_copies returns them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Salts at least, whatever the number of shuffle partitions.
LEAST_SALTS = 64


def mark_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    salts = max(LEAST_SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c, kind in docs.dtypes if c not in (text, key) and kind in ("string", "bigint", "int")]
    content = F.coalesce(F.col(text), F.lit(""))
    salt = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in others]))
    rows = docs.select(
        F.col(key).alias("doc_id"), content.alias("text"), F.pmod(salt, F.lit(salts)).cast("int").alias("salt")
    ).select("doc_id", "text", "salt", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("second"))
    salted = rows.groupBy("digest", "second", "salt", "text").agg(
        F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")
    )
    whole = salted.groupBy("digest", "second", "text").agg(
        F.max("winner").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.collect_set("salt").alias("salts"),  # at most `salts` small numbers
    )
    back = whole.select("digest", "second", "keep_id", "group_size", F.explode("salts").alias("salt"))
    return rows.drop("text").join(back, ["digest", "second", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return not isinstance(kind, T.MapType | T.VariantType)


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each different text, with all columns of docs: that of the largest doc_id, and where rows
    repeat both, the one with the greatest other columns (those that have no order, as maps, count by their JSON).
    Only such rows meet again in an aggregate."""
    kept = mark_copies(docs, text, key).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("__n"))
    kept = kept.withColumnsRenamed({"doc_id": "__kept_id", "text_sha256": "__kept_digest"})
    content = F.coalesce(F.col(text), F.lit(""))
    same = F.col(key).eqNullSafe(F.col("__kept_id")) & (F.sha2(content, 256) == F.col("__kept_digest"))
    single = docs.join(kept.where("__n = 1"), same, "left_semi")
    repeated = docs.join(kept.where("__n > 1"), same, "left_semi")
    rank = [F.col(f"`{c}`") if _ordered(f.dataType) else F.to_json(F.struct(F.col(f"`{c}`"))) for c, f in zip(docs.columns, docs.schema, strict=True)]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*rank)).alias("__best")
    one = repeated.groupBy(F.col(key).alias("__key"), content.alias("__content")).agg(best).select("__best.*")
    return single.unionByName(one)

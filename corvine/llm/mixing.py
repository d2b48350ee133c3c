"""Operator 8: mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The leaves of a tree, by default domain - language - source, hold documents; every node has a weight among
its siblings. A token budget flows from the root down. At each node the children share the budget in
proportion to their weights, but none gets more than all its documents give in MAX_EPOCHS epochs; what a
child cannot take is shared among its siblings again (water-filling). As a node never gets more than its
leaves can take, a shortage is made good among siblings first and reaches the parent's siblings only when
all of them are full.

A leaf with budget b and t tokens takes floor(b / t) whole epochs and, of the next epoch's order (a hash of
seed, epoch and doc_id), the documents while their running token count stays within the rest.

The running count never gathers a leaf: documents are counted by leaf and leading digits of their order
key, the counts are accumulated, and only the one bucket of each leaf that the rest falls into is ordered
row by row. The number of digits follows the number of documents.

Cases: NULL text has no token; NULL tree columns form a node named 'none'. Nodes without a weight weigh 1;
with weight 0 they get nothing. Rows that repeat a doc_id are separate documents that share their place; a
NULL doc_id has the order key of the empty text. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.llm.textkit import materialise

TREE = ("domain", "lang", "source")
MAX_EPOCHS = 4
#: Documents in a bucket of the running count, about.
BUCKET_DOCS = 4096
#: Leaves up to which their table is broadcast; a longer one is joined by shuffle.
BROADCAST_LEAVES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def weight_of(level: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def share_out(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """nodes: one row a child, with budget (of its parent), capacity and weight. Replaces budget by the
    child's own."""
    full = F.col("capacity") / F.col("weight")
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(full, level)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    live = nodes.where("weight > 0").withColumn("rate", (F.col("budget") - before) / rest)
    level_rate = F.max(F.when(full > F.col("rate"), F.col("rate"))).over(by)
    taken = F.when(full <= F.col("rate"), F.col("capacity")).otherwise(F.floor(level_rate * F.col("weight")))
    return live.withColumn("own", taken.cast("bigint")).drop("rate", "budget").withColumnRenamed("own", "budget")


def leaf_budgets(
    leaves: DataFrame, tree: tuple[str, ...], weights: dict[str, dict[str, float]], budget: int, max_epochs: int
) -> DataFrame:
    """leaves: the tree columns and tokens. Adds the budget of each leaf; leaves of weight 0 are left out."""
    out = leaves.select(*tree, "tokens", (F.col("tokens") * max_epochs).alias("capacity"))
    for level in tree:
        out = out.where(weight_of(level, weights.get(level, {})) > 0)
    share = None
    for k, level in enumerate(tree):
        nodes = out.groupBy(*tree[: k + 1]).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", weight_of(level, weights.get(level, {})))
        if share is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(budget).cast("bigint"), F.lit(2**62)))
        else:
            nodes = nodes.join(share, list(tree[:k]))
        share = share_out(nodes, list(tree[:k]), level).select(*tree[: k + 1], "budget")
    return out.select(*tree, "tokens").join(share, list(tree))


def plan_copies(
    docs: DataFrame,
    weights: dict[str, dict[str, float]],
    share: float,
    tree: tuple[str, ...] = TREE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """doc_id, tree columns, n_tokens and copies (0: not chosen) of every row. The budget is `share` of all
    tokens."""
    spark = docs.sparkSession
    rows = materialise(
        spark,
        docs.select(
            "doc_id",
            *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in tree],
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens"),
        ),
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).first()
    leaves = rows.groupBy(*tree).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, tree, weights, int((total["t"] or 0) * share), max_epochs)
    plan = materialise(
        spark,
        plan.select(
            *tree,
            F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("bigint").alias("epochs"),
            F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).alias("rest"),
        ),
    )
    digits = 1
    while 16**digits * BUCKET_DOCS < total["n"]:
        digits += 1
    small = plan.count() <= BROADCAST_LEAVES
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(F.broadcast(plan) if small else plan, list(tree), "left").withColumn("place", key)
    placed = placed.withColumn("bucket", F.substring("place", 1, digits))
    live = placed.where(F.col("rest").isNotNull())
    until = Window.partitionBy(*tree).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = (
        live.groupBy(*tree, "rest", "bucket")
        .agg(F.sum("n_tokens").alias("s"))
        .withColumn("stop", F.sum("s").over(until))
        .withColumn("start", F.col("stop") - F.col("s"))
        .where("start <= rest")
        .select(*tree, "bucket", "start", (F.col("stop") <= F.col("rest")).alias("whole"))
    )
    met = live.join(sums, [*tree, "bucket"], "left")
    within = Window.partitionBy(*tree, "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = met.where(~F.col("whole")).withColumn(
        "more", (F.col("start") + F.sum("n_tokens").over(within) <= F.col("rest")).cast("bigint")
    )
    sure = met.where(F.col("whole").isNull() | F.col("whole")).withColumn("more", F.col("whole").isNotNull().cast("bigint"))
    never = placed.where(F.col("rest").isNull()).withColumns({"more": F.lit(0).cast("bigint"), "epochs": F.lit(0).cast("bigint")})
    out = [x.select("doc_id", *tree, "n_tokens", (F.col("epochs") + F.col("more")).alias("copies")) for x in (cut, sure, never)]
    return out[0].unionAll(out[1]).unionAll(out[2])


def domain_of(source: str = "source") -> Column:
    """Stand-in domain of these tables: the number in a source's name, modulo 4."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d+)", 1)
    return F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("d"), F.substring(number, -1, 1).cast("int") % 4))

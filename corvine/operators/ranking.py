"""Rankers and what happens to ranked rows: overlap removal, the cap for each file, limits, fusion.

Every ranking ends in one total order, so that equal scores give the same rows on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import scoring as S
from corvine.functions import text as X
from corvine.schema import KEY, Request

PER_FILE = 3


def total_order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("file_path"), F.asc("start_line"), F.desc("end_line"), F.asc("kind"), F.asc("name")]


def with_tokens(blocks: DataFrame) -> DataFrame:
    """Adds tokens and their count, once for all terms of a query; an index keeps them as columns."""
    if "tokens" not in blocks.columns:
        blocks = blocks.withColumn("tokens", X.tokens(X.document_text()))
    return blocks.withColumn("length", F.size("tokens"))


def keep_path(blocks: DataFrame, path: str | None) -> DataFrame:
    return blocks if path is None else blocks.where(F.contains("file_path", F.lit(path)))


def keep_languages(blocks: DataFrame, languages: list[str] | None) -> DataFrame:
    return blocks if languages is None else blocks.where(F.col("language").isin(languages))


def corpus_stats(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """One row: n, average length, and df0, df1, ... of the terms, over the rows given."""
    dfs = [
        F.count_if(S.holds(F.col("content"), F.col("name"), F.lit(t))).alias(f"df{i}") for i, t in enumerate(terms)
    ]
    return blocks.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"), *dfs)


def _facts(blocks: DataFrame, terms: list[str], keep: list) -> DataFrame:
    """keep columns, and all that statistics and scores ask of a row: its length, and for each term twice its
    frequency, plus one if the row holds the term at all. One column, so that both need the same columns."""

    def fact(t: str) -> Column:
        held = F.coalesce(S.holds(F.col("content"), F.col("name"), F.lit(t)), F.lit(False))
        return 2 * S.term_frequency(F.col("tokens"), F.lit(t)).cast("bigint") + held.cast("bigint")

    return with_tokens(blocks).select(*keep, "length", F.array(*map(fact, terms)).alias("__facts"))


def _frequency(k: int) -> Column:
    return F.shiftright(F.get("__facts", F.lit(k)), 1).cast("double")


def _holds(k: int) -> Column:
    return F.get("__facts", F.lit(k)).bitwiseAND(F.lit(1)) == 1


def _sum_of_terms(terms: list[str], own: list[str], n: Column, average: Column, df) -> Column:
    """BM25 of a row of _facts; a term that the query repeats counts again."""
    total = F.lit(0.0)
    for t in terms:
        k = own.index(t)
        total = total + S.bm25_term(_frequency(k), S.idf(n, df(k)), F.col("length"), average)
    return total


def _scored(facts: DataFrame, query: str, terms: list[str], own: list[str], keep: list[str]) -> DataFrame:
    """keep columns and score of the rows that score above zero; statistics are over all rows of facts. They are
    one row, which is broadcast whatever the size of the corpus. Both sides use every column of facts, so that a
    shuffle below them is made once for both."""
    stats = facts.agg(
        F.count(F.lit(1)).alias("__n"),
        F.avg("length").alias("__average"),
        F.max(F.xxhash64(*facts.columns)).alias("__any"),
        *[F.count_if(_holds(k)).alias(f"__df{k}") for k in range(len(own))],
    ).where(F.col("__any").isNotNull())
    met = facts.crossJoin(F.broadcast(stats))  # a filter here would go below the shuffle, and part the two sides
    score = _sum_of_terms(terms, own, F.col("__n"), F.col("__average"), lambda k: F.col(f"__df{k}"))
    score = score * S.name_boost(F.col("name"), F.col("kind"), F.lit(query)) * S.kind_boost(F.col("kind"))
    return met.select(*keep, score.alias("score")).where((F.col("score") > 0) & ~F.isnan("score"))


def bm25_scores(blocks: DataFrame, query: str) -> DataFrame:
    """Adds score and keeps what scores above zero. Statistics are of the rows given, so filters come first."""
    terms = X.query_terms(query)
    if not terms:
        return blocks.withColumn("score", F.lit(0.0)).where(F.lit(False))
    own = list(dict.fromkeys(terms))
    keep = [c for c in blocks.columns if c not in ("tokens", "length")]
    return _scored(_facts(blocks, own, keep), query, terms, own, keep)


def outermost(ranked: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Of blocks of one file that contain each other, the outermost; of equal ranges, the best. A row stays if
    it ends after every earlier one, in order of start, then of descending end. by: columns, as a query's
    number, within which rows meet."""
    earlier = (
        Window.partitionBy(*by, "file_path")
        .orderBy(F.asc("start_line"), F.desc("end_line"), F.desc(score), F.asc("kind"), F.asc("name"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranked.withColumn("__reach", F.max("end_line").over(earlier))
        .where(F.col("__reach").isNull() | (F.col("__reach") < F.col("end_line")))
        .drop("__reach")
    )


def outermost_in_parts(ranked: DataFrame, lines: int, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """outermost() for files with more hits than a task should order: the hits of `lines` lines are one part, and a
    part is ordered by itself. How far the parts before reach is a running maximum over one row for each part."""
    part = F.floor(F.col("start_line") / lines).alias("__part")
    rows = ranked.withColumn("__part", part)
    ends = rows.groupBy(*by, "file_path", "__part").agg(F.max("end_line").alias("__end"))
    ahead = Window.partitionBy(*by, "file_path").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*by, "file_path", "__part", F.max("__end").over(ahead).alias("__before"))
    met = rows.join(before, [*by, "file_path", "__part"])
    earlier = (
        Window.partitionBy(*by, "file_path", "__part")
        .orderBy(F.asc("start_line"), F.desc("end_line"), F.desc(score), F.asc("kind"), F.asc("name"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.greatest(F.max("end_line").over(earlier), F.col("__before"))  # the greatest passes over NULLs
    kept = met.withColumn("__reach", reach).where(F.col("__reach").isNull() | (F.col("__reach") < F.col("end_line")))
    return kept.select(*ranked.columns)


def innermost(ranked: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """The reverse choice: blocks that contain no other kept one; of equal ranges, the best."""
    order = [F.desc("start_line"), F.asc("end_line"), F.desc(score), F.asc("kind"), F.asc("name")]
    earlier = Window.partitionBy(*by, "file_path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.withColumn("__reach", F.min("end_line").over(earlier))
        .where(F.col("__reach").isNull() | (F.col("__reach") > F.col("end_line")))
        .drop("__reach")
    )


def cap_per_file(ranked: DataFrame, most: int = PER_FILE, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    order = Window.partitionBy(*by, "file_path").orderBy(*total_order(score))
    return ranked.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def top(ranked: DataFrame, limit: int, score: str = "score") -> DataFrame:
    return ranked.orderBy(*total_order(score)).limit(limit)


def without_overlap(ranked: DataFrame, overlap: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Of blocks that contain each other the outer or the inner ones."""
    if overlap not in ("outer", "inner"):
        raise ValueError(f"overlap: {overlap}")
    return outermost(ranked, by=by) if overlap == "outer" else innermost(ranked, by=by)


def listed(ranked: DataFrame, by: str, limit: Column) -> DataFrame:
    """The first rows of each list, up to its limit, with their ordinal from 1."""
    order = Window.partitionBy(by).orderBy(*total_order())
    return ranked.withColumn("ordinal", F.row_number().over(order).cast("bigint")).where(F.col("ordinal") <= limit)


def diversify(ranked: DataFrame, limit: int, overlap: str = "outer") -> DataFrame:
    """Overlap removal, then the cap, then the limit; the order is part of the meaning."""
    return top(cap_per_file(without_overlap(ranked, overlap)), limit)


def block_mark() -> Column:
    """Tells blocks apart that share key, kind and name."""
    return F.xxhash64("content", "signature", "parent").alias("__mark")


def bm25_search(blocks: DataFrame, query: str, languages: list[str] | None, limit: int, overlap: str = "outer") -> DataFrame:
    """The texts are read and cut into tokens once: keys and the few numbers that a score needs cross one shuffle,
    from which both the statistics and the scores are made. The whole rows are read again for the blocks that
    remain, `limit` at most."""
    blocks = keep_languages(blocks, languages)
    terms = X.query_terms(query)
    if not terms:
        return blocks.drop("tokens").withColumn("score", F.lit(0.0)).where(F.lit(False))
    own, keys = list(dict.fromkeys(terms)), [*KEY, "kind", "name"]
    facts = _facts(blocks, own, [*keys, block_mark()]).repartition(*KEY)
    narrow = _scored(facts, query, terms, own, [*keys, "__mark"])
    return top(whole_rows(blocks, diversify(narrow, limit, overlap), limit), limit)


#: Rows up to which a list of results is broadcast to the blocks; a longer one is joined by shuffle.
BROADCAST_ROWS = 10_000


def whole_rows(blocks: DataFrame, best: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The blocks that best names by key, kind, name and mark, with its other columns."""
    keys = [*KEY, "kind", "name"]
    listed = F.broadcast(best) if limit <= BROADCAST_ROWS else best
    whole = blocks.drop("tokens").withColumn("__mark", block_mark()).join(listed, [*keys, "__mark"])
    # overlap removal leaves one block a key; what is still alike here is equal, too
    first = Window.partitionBy(*by, *KEY).orderBy("kind", "name")
    found = whole.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    own = [c for c in blocks.columns if c != "tokens"]
    return found.select(*by, *own, *[c for c in best.columns if c not in (*by, *keys, "__mark", *own)])


#: Requests that one pass over the blocks answers.
REQUESTS = 32


def bm25_many(blocks: DataFrame, requests: list[Request]) -> DataFrame:
    """bm25_search for many requests: their rows, with the number of the request as `request`.

    REQUESTS at a time share a pass: a block's terms are counted once for all, the statistics of all are one row,
    and a block gives a row only for requests whose filters it passes and one of whose terms it holds. Keys and
    scores alone reach the rankings, whose windows Spark limits before their shuffle."""
    asked = [(i, r, X.query_terms(r.query)) for i, r in enumerate(requests)]
    asked = [x for x in asked if x[2]]
    parts = [_many(blocks, asked[a : a + REQUESTS]) for a in range(0, max(len(asked), 1), REQUESTS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _many(blocks: DataFrame, asked: list[tuple[int, Request, list[str]]]) -> DataFrame:
    keys = [*KEY, "kind", "name"]
    own = list(dict.fromkeys(t for *_, terms in asked for t in terms))
    facts = _facts(blocks, own, [*keys, "language", block_mark()]).repartition(*KEY)

    def fits(r: Request) -> Column:
        by_language = F.lit(True) if r.languages is None else F.coalesce(F.col("language").isin(r.languages), F.lit(False))
        return by_language if r.path is None else by_language & F.coalesce(F.contains("file_path", F.lit(r.path)), F.lit(False))

    holds = lambda t: _holds(own.index(t))
    sums = [F.max(F.xxhash64(*facts.columns)).alias("__any")]
    for i, r, terms in asked:
        sums += [F.count_if(fits(r)).alias(f"__n{i}"), F.avg(F.when(fits(r), F.col("length"))).alias(f"__average{i}")]
        sums += [F.count_if(fits(r) & holds(t)).alias(f"__df{i}_{own.index(t)}") for t in dict.fromkeys(terms)]
    met = facts.crossJoin(F.broadcast(facts.agg(*sums).where(F.col("__any").isNotNull())))
    found = [F.lit(None).cast("struct<request:int,limit:int,score:double>")]
    for i, r, terms in asked:
        total = _sum_of_terms(terms, own, F.col(f"__n{i}"), F.col(f"__average{i}"), lambda k, i=i: F.col(f"__df{i}_{k}"))
        score = total * S.name_boost(F.col("name"), F.col("kind"), F.lit(r.query)) * S.kind_boost(F.col("kind"))
        row = F.struct(F.lit(i).alias("request"), F.lit(r.limit).alias("limit"), score.alias("score"))
        matches = fits(r)
        matches = matches & F.exists(F.array(*[holds(t) for t in dict.fromkeys(terms)]), lambda x: x)
        found.append(F.when(matches, row))
    rows = met.select(*keys, "__mark", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    scored = rows.select(*keys, "__mark", "x.request", F.col("x.limit").alias("__limit"), "x.score").where((F.col("score") > 0) & ~F.isnan("score"))
    best = cap_per_file(outermost(scored, by=("request",)), by=("request",))
    order = Window.partitionBy("request").orderBy(*total_order())
    best = best.withColumn("ordinal", F.row_number().over(order).cast("bigint"))
    limit = max((r.limit for _, r, _ in asked), default=0)
    best = best.where(F.col("ordinal") <= limit).where("ordinal <= __limit").drop("__limit")
    return whole_rows(blocks, best, limit * len(asked), ("request",))


def vector_scores(blocks: DataFrame, vectors: DataFrame, wanted: list[float]) -> DataFrame:
    """Keys of the blocks that have a vector, with its dot product. The request's vector is a literal."""
    q = F.array(*[F.lit(float(x)) for x in wanted])
    known = vectors.select(*KEY, "embedding").join(blocks.select(*KEY), KEY, "left_semi")
    return known.select(*KEY, S.dot(F.col("embedding"), q).alias("cosine"))


def vector_top(scores: DataFrame, limit: int) -> DataFrame:
    return scores.orderBy(F.desc("cosine"), "file_path", "start_line", F.desc("end_line")).limit(limit)


def best_per_key(rows: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    order = Window.partitionBy(*by, *KEY).orderBy(*total_order(score))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def fuse(
    bm25: DataFrame, vectors: DataFrame, blocks: DataFrame, alpha: float = S.ALPHA, limit: int | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Full outer fusion of two candidate lists on the block key, within the columns by. BM25 scores are scaled to
    [0, 1] over their list, by a window over it, so it is made once; a side that misses a block counts as 0. limit:
    rows of both lists at most, if known; only a short list is broadcast to the blocks."""
    all_rows = Window.partitionBy(*by)  # a list of candidates, not the corpus
    spanned = bm25.select(*by, *KEY, "kind", "name", "score", F.min("score").over(all_rows).alias("lo"), F.max("score").over(all_rows).alias("hi"))
    left = best_per_key(spanned, by=by).select(*by, *KEY, S.min_max(F.col("score"), F.col("lo"), F.col("hi")).alias("b"))
    right = vectors.select(*by, *KEY, S.rescale(F.col("cosine")).alias("v"))
    both = left.join(right, [*by, *KEY], "full_outer").select(
        *by, *KEY, (alpha * F.coalesce("b", F.lit(0.0)) + (1 - alpha) * F.coalesce("v", F.lit(0.0))).alias("score")
    )
    first = Window.partitionBy(*by, *KEY).orderBy("kind", "name")
    listed = F.broadcast(both) if limit is not None and limit <= BROADCAST_ROWS else both
    found = blocks.drop("tokens").join(listed, KEY).withColumn("__n", F.row_number().over(first))
    return found.where("__n = 1").drop("__n")

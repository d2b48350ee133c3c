"""Queries over the driver's tables, with DuckDB SQL.

The tables hold no source code, so operators run on analogues: documents as blocks of files named by their
source, conversations as files with nested line ranges, embeddings as vectors, events as a change log and
pages as markup and paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.functions import scoring as S
from corvine.functions import text as X
from corvine.operators import ranking as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as blocks: one block a document, in the file of its source; lines follow the doc_id."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    line = (F.col("doc_id") + 1).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("file_path"),
        line.alias("start_line"),
        line.alias("end_line"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.lit("Other").alias("kind"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        none.alias("parent"),
        none.alias("signature"),
        empty.alias("annotations"),
        empty.alias("dependencies"),
        "doc_id",
    )


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as files: a block for each turn, and one that spans them all."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "Class").when(F.col("role") == "assistant", "Method").otherwise("Field")
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    line = (F.col("turn") + 1).cast("int")
    shape = lambda path, start, end, content, kind, name: [
        path.alias("file_path"),
        start.alias("start_line"),
        end.alias("end_line"),
        content.alias("content"),
        F.lit("en").alias("language"),
        kind.alias("kind"),
        name.alias("name"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("signature"),
        F.array().cast("array<string>").alias("annotations"),
        F.array().cast("array<string>").alias("dependencies"),
    ]
    own = turns.select(*shape(path, line, line, F.col("text"), kind, F.concat(F.col("role"), F.lit("_"), F.col("turn").cast("string"))))
    whole = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.first("role").alias("r")).select(
        *shape(path, F.lit(1), (F.col("last") + 1).cast("int"), F.concat(F.lit("conversation "), path), F.lit("Class"), F.lit("whole"))
    )
    return own.unionByName(whole)


def ranked(df: DataFrame, *columns: str, score: str = "score") -> DataFrame:
    """The result columns, with scores on six decimals and integers as BIGINT."""
    out = []
    for c in columns:
        kind = dict(df.dtypes)[c]
        e = F.col(c)
        out.append(F.round(e, 6).alias(c) if kind == "double" else e.cast("bigint").alias(c) if kind == "int" else e)
    return df.select(*out)


#: The separators of tokens for DuckDB, whose \s is ASCII only.
SEP = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.,;(){}<>:/\\]+"


def tokens_sql(text: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array({text}, '{SEP}'), lambda x: x <> ''), lambda x: lower(x))"


DOCS = f"""docs AS (SELECT doc_id, source AS file_path, doc_id + 1 AS line, lang AS language, text AS content, 'doc_' || doc_id AS name,
    {tokens_sql("concat_ws(' ', 'doc_' || doc_id, text)")} AS tokens FROM documents)"""
CONV = """conv AS (SELECT 'c' || conv_id AS file_path, turn + 1 AS start_line, turn + 1 AS end_line, text AS content,
      CASE role WHEN 'system' THEN 'Class' WHEN 'assistant' THEN 'Method' ELSE 'Field' END AS kind, role || '_' || turn AS name FROM conversations
    UNION ALL SELECT 'c' || conv_id, 1, max(turn) + 1, 'conversation c' || conv_id, 'Class', 'whole' FROM conversations GROUP BY conv_id)"""


def bm25_sql(source: str, terms: list[str], where: str = "true", boost: str = "1.0") -> str:
    """CTEs st (statistics) and sc (scores) over a CTE with tokens, content and name."""
    dfs = ", ".join(f"count(*) FILTER (contains(lower(content), '{t}') OR contains(lower(name), '{t}')) AS df{i}" for i, t in enumerate(terms))
    parts = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1), 0) * (len(list_filter(tokens, lambda x: x = '{t}')) * 2.5)"
        f" / (len(list_filter(tokens, lambda x: x = '{t}')) + 1.5 * (1 - 0.75 + 0.75 * len(tokens) / average))"
        for i, t in enumerate(terms)
    )
    return f"""f AS (SELECT * FROM {source} WHERE {where}),
    st AS (SELECT count(*) AS n, avg(len(tokens)) AS average, {dfs} FROM f),
    sc AS (SELECT * FROM (SELECT f.*, ({parts}) * ({boost}) AS score FROM f, st) WHERE score > 0)"""


TOP = "ORDER BY score DESC, file_path, start_line, end_line DESC, kind, name"
ROUND = "round(score, 6) AS score"


@query("tokenize_count", f"WITH {DOCS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens[1:5], '|') AS head FROM docs")
def tokenize_count(spark, sf_dir):
    rows = document_blocks(spark, sf_dir).select("doc_id", X.tokens(X.document_text()).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), "|").alias("head"))


@query("doc_text", "SELECT doc_id, md5(concat_ws(' ', 'doc_' || doc_id, text)) AS digest FROM documents")
def doc_text(spark, sf_dir):
    return document_blocks(spark, sf_dir).select("doc_id", F.md5(X.document_text()).alias("digest"))


@query("embed_text", "SELECT doc_id, md5(lang || ' Other doc_' || doc_id || chr(10) || left(text, 500)) AS digest FROM documents")
def embed_text(spark, sf_dir):
    return document_blocks(spark, sf_dir).select("doc_id", F.md5(X.embedding_text()).alias("digest"))


@query(
    "term_freq",
    f"""WITH {DOCS} SELECT doc_id, CAST(len(list_filter(tokens, lambda x: x = 'the')) AS BIGINT) AS tf_the,
    CAST(len(list_filter(tokens, lambda x: x = 'and')) AS BIGINT) AS tf_and FROM docs""",
)
def term_freq(spark, sf_dir):
    rows = R.with_tokens(document_blocks(spark, sf_dir))
    tf = lambda t: S.term_frequency(F.col("tokens"), F.lit(t)).cast("bigint").alias(f"tf_{t}")
    return rows.select("doc_id", tf("the"), tf("and"))


@query("doc_freq_substring", f"WITH {DOCS}, {bm25_sql('docs', ['the', 'doc_1', 'ing'])} SELECT n, df0, df1, df2 FROM st")
def doc_freq_substring(spark, sf_dir):
    return R.corpus_stats(R.with_tokens(document_blocks(spark, sf_dir)), ["the", "doc_1", "ing"]).drop("average")


@query("corpus_stats", f"WITH {DOCS}, {bm25_sql('docs', ['the'], "language = 'en'")} SELECT n, round(average, 6) AS average, df0 FROM st")
def corpus_stats(spark, sf_dir):
    rows = R.keep_languages(document_blocks(spark, sf_dir), ["en"])
    return ranked(R.corpus_stats(R.with_tokens(rows), ["the"]), "n", "average", "df0")


@query(
    "idf",
    f"""WITH {DOCS}, {bm25_sql('docs', ['the', 'ing', 'zz'])}
    SELECT round(ln((n - df0 + 0.5) / (df0 + 0.5) + 1), 6) AS i0, round(ln((n - df1 + 0.5) / (df1 + 0.5) + 1), 6) AS i1,
    round(ln((n - df2 + 0.5) / (df2 + 0.5) + 1), 6) AS i2 FROM st""",
)
def idf(spark, sf_dir):
    st = R.corpus_stats(R.with_tokens(document_blocks(spark, sf_dir)), ["the", "ing", "zz"])
    return st.select(*[F.round(S.idf(F.col("n"), F.col(f"df{i}")), 6).alias(f"i{i}") for i in range(3)])


def _doc_boost(query_text: str) -> str:
    return f"CASE WHEN lower(name) = '{query_text}' THEN 2.0 WHEN contains(lower(name), '{query_text}') THEN 1.5 ELSE 1.0 END"


def _doc_top(query_text: str, where: str, limit: int) -> str:
    terms = query_text.split()
    return f"""WITH {DOCS}, {bm25_sql('docs', terms, where, _doc_boost(query_text))},
    cap AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, line) AS k FROM sc)
    SELECT doc_id, {ROUND} FROM cap WHERE k <= 3 ORDER BY cap.score DESC, file_path, line LIMIT {limit}"""


@query("bm25_topk", _doc_top("the thing", "true", 10))
def bm25_topk(spark, sf_dir):
    return ranked(R.bm25_search(document_blocks(spark, sf_dir), "the thing", None, 10), "doc_id", "score")


@query("bm25_lang", _doc_top("que la", "language IN ('es', 'fr')", 10))
def bm25_lang(spark, sf_dir):
    return ranked(R.bm25_search(document_blocks(spark, sf_dir), "que la", ["es", "fr"], 10), "doc_id", "score")


@query("bm25_path", _doc_top("the", "contains(file_path, 'src1')", 20))
def bm25_path(spark, sf_dir):
    rows = R.keep_path(document_blocks(spark, sf_dir), "src1")
    return ranked(R.bm25_search(rows, "the", None, 20), "doc_id", "score")


@query("bm25_scores", f"WITH {DOCS}, {bm25_sql('docs', ['the', 'thing'], 'true', _doc_boost('the thing'))} SELECT doc_id, {ROUND} FROM sc")
def bm25_scores(spark, sf_dir):
    return ranked(R.bm25_scores(document_blocks(spark, sf_dir), "the thing"), "doc_id", "score")


@query("bm25_repeated_term", f"WITH {DOCS}, {bm25_sql('docs', ['the', 'the', 'of'], 'true', _doc_boost('the the of'))} SELECT doc_id, {ROUND} FROM sc")
def bm25_repeated_term(spark, sf_dir):
    return ranked(R.bm25_scores(document_blocks(spark, sf_dir), "the the of"), "doc_id", "score")


def _name_boost_sql(q: str) -> str:
    return f"""CASE WHEN lower(name) = '{q}' THEN CASE WHEN kind IN ('Class', 'Interface', 'Enum') THEN 5.0 WHEN kind IN ('Method', 'Constructor') THEN 3.0 ELSE 2.0 END
      WHEN contains(lower(name), '{q}') THEN CASE WHEN kind IN ('Class', 'Interface', 'Enum') THEN 2.5 ELSE 1.5 END ELSE 1.0 END"""


_KIND_SQL = "CASE kind WHEN 'Class' THEN 2.0 WHEN 'Method' THEN 1.3 WHEN 'Field' THEN 1.0 ELSE 1.0 END"
_CONV_SORT = "file_path, start_line, end_line, kind, name"


_MANY = [("the thing", "true", 10), ("que la", "language IN ('es', 'fr')", 5), ("the", "contains(file_path, 'src1')", 20)]


@query(
    "bm25_many",
    " UNION ALL ".join(
        f"SELECT {i} AS request, doc_id, score FROM ({_doc_top(q, where, limit)})" for i, (q, where, limit) in enumerate(_MANY)
    ).replace("SELECT 0 AS", "SELECT CAST(0 AS BIGINT) AS"),
)
def bm25_many(spark, sf_dir):
    from corvine.plans.engine import Engine
    from corvine.schema import Request

    asked = [Request("the thing"), Request("que la", lang="es, fr", limit=5), Request("the", path="src1", limit=20)]
    return ranked(Engine(document_blocks(spark, sf_dir)).search_many(asked), "request", "doc_id", "score")


@query("bm25_postings", ORACLE["bm25_many"])
def bm25_postings(spark, sf_dir):
    """The requests of bm25_many as a table, answered from posting lists."""
    from corvine.operators.postings import Postings, request_table
    from corvine.schema import Request

    lists = Postings(spark, scratch(spark, "postings"))
    lists.write(document_blocks(spark, sf_dir))
    asked = request_table(spark, [Request("the thing"), Request("que la", lang="es, fr", limit=5), Request("the", path="src1", limit=20)])
    doc_id = F.regexp_extract("name", r"^doc_(\d+)$", 1).cast("bigint")
    return ranked(lists.search(asked).withColumn("doc_id", doc_id), "request", "doc_id", "score")


_WORDS_OF = ["th", "ing", "e", "tion", "none of these"]


@query(
    "postings_words",
    f"""WITH {DOCS}, w AS (SELECT DISTINCT unnest(list_concat({tokens_sql("lower(content)")}, {tokens_sql("lower(name)")})) AS word FROM docs),
    t AS (SELECT unnest({_WORDS_OF}) AS term) SELECT term, word FROM t JOIN w ON contains(word, term)""",
)
def postings_words(spark, sf_dir):
    """The indexed words that hold a term, by their grams."""
    from corvine.operators.postings import Postings

    lists = Postings(spark, scratch(spark, "postings"))
    lists.write(document_blocks(spark, sf_dir))
    return lists.words_of(spark.createDataFrame([(t,) for t in _WORDS_OF], "term string"))


@query("name_boost", f"WITH {CONV} SELECT file_path, start_line, end_line, name, CAST({_name_boost_sql('user_1')} AS DOUBLE) AS a, CAST({_name_boost_sql('assistant')} AS DOUBLE) AS b FROM conv")
def name_boost(spark, sf_dir):
    rows = conversation_blocks(spark, sf_dir)
    for c, q in (("a", "user_1"), ("b", "assistant")):
        rows = rows.withColumn(c, S.name_boost(F.col("name"), F.col("kind"), F.lit(q)))
    return ranked(rows, "file_path", "start_line", "end_line", "name", "a", "b")


@query("kind_boost", f"WITH {CONV} SELECT kind, CAST({_KIND_SQL} AS DOUBLE) AS boost, count(*) AS n FROM conv GROUP BY 1, 2")
def kind_boost(spark, sf_dir):
    rows = conversation_blocks(spark, sf_dir).withColumn("boost", S.kind_boost(F.col("kind")))
    return rows.groupBy("kind", "boost").agg(F.count(F.lit(1)).alias("n"))


_CONV_SCORE = "scored AS (SELECT *, CAST(len(content) AS DOUBLE) AS score FROM conv)"
_OUTER = f"""o AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line DESC, score DESC, kind, name
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM scored), kept AS (SELECT * FROM o WHERE reach IS NULL OR reach < end_line)"""


def _conv_scored(spark, sf_dir):
    return conversation_blocks(spark, sf_dir).withColumn("score", F.length("content").cast("double"))


@query("overlap_outermost", f"WITH {CONV}, {_CONV_SCORE}, {_OUTER} SELECT file_path, start_line, end_line, kind, name FROM kept")
def overlap_outermost(spark, sf_dir):
    return ranked(R.outermost(_conv_scored(spark, sf_dir)), "file_path", "start_line", "end_line", "kind", "name")


@query("overlap_in_parts", ORACLE["overlap_outermost"])
def overlap_in_parts(spark, sf_dir):
    """The same for files of any number of hits, three lines a part."""
    return ranked(R.outermost_in_parts(_conv_scored(spark, sf_dir), 3), "file_path", "start_line", "end_line", "kind", "name")


def not_contained(rows: DataFrame) -> DataFrame:
    """Blocks that no other block of their file contains, by an anti join; of equal ranges under different names
    none stays. The work grows with the square of a file's blocks, which R.outermost avoids."""
    own = ["file_path", "start_line", "end_line", "name"]
    a, b = rows.alias("a"), rows.select(*own).alias("b")
    mine, other = (F.struct(*[F.col(f"{t}.{c}") for c in own[1:]]) for t in "ab")
    holds = (F.col("b.start_line") <= F.col("a.start_line")) & (F.col("b.end_line") >= F.col("a.end_line"))
    return a.join(b, (F.col("a.file_path") == F.col("b.file_path")) & holds & (mine != other), "left_anti")


@query(
    "overlap_antijoin",
    f"""WITH {CONV}, {_CONV_SCORE} SELECT file_path, start_line, end_line, name FROM scored a WHERE name <> 'whole' AND NOT EXISTS (
    SELECT 1 FROM scored b WHERE b.name <> 'whole' AND a.file_path = b.file_path AND (b.start_line, b.end_line, b.name) <> (a.start_line, a.end_line, a.name)
      AND b.start_line <= a.start_line AND b.end_line >= a.end_line)""",
)
def overlap_antijoin(spark, sf_dir):
    rows = conversation_blocks(spark, sf_dir).where("name <> 'whole'")
    return ranked(not_contained(rows), "file_path", "start_line", "end_line", "name")


@query(
    "overlap_innermost",
    f"""WITH {CONV}, {_CONV_SCORE}, o AS (SELECT *, min(end_line) OVER (PARTITION BY file_path ORDER BY start_line DESC, end_line, score DESC, kind, name
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM scored)
    SELECT file_path, start_line, end_line, kind, name FROM o WHERE reach IS NULL OR reach > end_line""",
)
def overlap_innermost(spark, sf_dir):
    return ranked(R.innermost(_conv_scored(spark, sf_dir)), "file_path", "start_line", "end_line", "kind", "name")


@query(
    "per_file_cap",
    """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3""",
)
def per_file_cap(spark, sf_dir):
    rows = document_blocks(spark, sf_dir).withColumn("score", F.length("content").cast("double"))
    return R.cap_per_file(rows).select("doc_id", F.col("file_path").alias("source"))


_CONV_TOKENS = "ct AS (SELECT *, " + tokens_sql("concat_ws(' ', name, content)") + " AS tokens FROM conv)"


@query(
    "bm25_full",
    f"""WITH {CONV}, {_CONV_TOKENS}, {bm25_sql('ct', ['the'], 'true', f"{_name_boost_sql('the')} * {_KIND_SQL}")}, scored AS (SELECT * FROM sc), {_OUTER},
    cap AS (SELECT *, row_number() OVER (PARTITION BY file_path {TOP}) AS k FROM kept)
    SELECT file_path, start_line, end_line, name, {ROUND} FROM cap WHERE k <= 3 {TOP.replace('score DESC', 'cap.score DESC')} LIMIT 15""",
)
def bm25_full(spark, sf_dir):
    return ranked(R.bm25_search(conversation_blocks(spark, sf_dir), "the", None, 15), "file_path", "start_line", "end_line", "name", "score")


def _vectors(spark, sf_dir):
    line = (F.col("vec_id") + 1).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_path"))
    v = table(spark, sf_dir, "embeddings")
    return v.join(docs, v.vec_id == docs.doc_id).select("file_path", line.alias("start_line"), line.alias("end_line"), "embedding")


def _wanted(spark, sf_dir) -> list[float]:
    """The request's vector: that of the smallest vec_id."""
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return list(row["embedding"]) if row else []


_COS = """v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
    q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
    cs AS (SELECT vec_id AS doc_id, source AS file_path, vec_id + 1 AS line,
      list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS cosine
      FROM v JOIN documents ON vec_id = doc_id, q)"""


@query("cosine_topk", f"WITH {_COS} SELECT doc_id, round(cosine, 6) AS cosine FROM cs ORDER BY cs.cosine DESC, file_path, line LIMIT 90")
def cosine_topk(spark, sf_dir):
    scores = R.vector_scores(document_blocks(spark, sf_dir), _vectors(spark, sf_dir), _wanted(spark, sf_dir))
    best = R.vector_top(scores, 90).withColumn("doc_id", F.col("start_line").cast("bigint") - 1)
    return ranked(best, "doc_id", "cosine")


@query("cosine_rescaled", f"WITH {_COS} SELECT doc_id, round((cosine + 1) / 2, 6) AS v FROM cs")
def cosine_rescaled(spark, sf_dir):
    scores = R.vector_scores(document_blocks(spark, sf_dir), _vectors(spark, sf_dir), _wanted(spark, sf_dir))
    return scores.select((F.col("start_line").cast("bigint") - 1).alias("doc_id"), F.round(S.rescale(F.col("cosine")), 6).alias("v"))


@query(
    "minmax_scores",
    f"""WITH {DOCS}, {bm25_sql('docs', ['of'], 'true', _doc_boost('of'))}, t AS (SELECT * FROM sc ORDER BY score DESC, file_path, line LIMIT 30),
    r AS (SELECT min(score) AS lo, max(score) AS hi FROM t)
    SELECT doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS b FROM t, r""",
)
def minmax_scores(spark, sf_dir):
    best = R.top(R.bm25_scores(document_blocks(spark, sf_dir), "of"), 30)
    span = best.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return best.crossJoin(F.broadcast(span)).select("doc_id", F.round(S.min_max(F.col("score"), F.col("lo"), F.col("hi")), 6).alias("b"))


def _fused_sql(part: str = "") -> str:
    """For files whose path holds a part."""
    inside = f"contains(file_path, '{part}')"
    near = _COS.replace("doc_id, q)", f"doc_id, q WHERE {inside.replace('file_path', 'source')})")
    return f"""{DOCS}, {bm25_sql('docs', ['the', 'of'], inside, _doc_boost('the of'))}, {near},
    cap AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, line) AS k FROM sc),
    bl AS (SELECT * FROM cap WHERE k <= 3 ORDER BY score DESC, file_path, line LIMIT 30),
    vl AS (SELECT * FROM cs ORDER BY cosine DESC, file_path, line LIMIT 90), r AS (SELECT min(score) AS lo, max(score) AS hi FROM bl),
    fu AS (SELECT coalesce(bl.doc_id, vl.doc_id) AS doc_id, coalesce(bl.file_path, vl.file_path) AS file_path, coalesce(bl.line, vl.line) AS line,
      0.5 * coalesce(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score IS NOT NULL THEN 1.0 END, 0) + 0.5 * coalesce((cosine + 1) / 2, 0) AS score
      FROM bl FULL JOIN vl ON bl.doc_id = vl.doc_id, r)"""


_FUSED = _fused_sql()


def _hybrid_sql(part: str = "") -> str:
    return f"""WITH {_fused_sql(part)}, c2 AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, line) AS k2 FROM fu)
    SELECT doc_id, {ROUND} FROM c2 WHERE k2 <= 3 ORDER BY c2.score DESC, file_path, line LIMIT 10"""


def _fused(spark, sf_dir):
    blocks = document_blocks(spark, sf_dir)
    best = R.bm25_search(blocks, "the of", None, 30)
    near = R.vector_top(R.vector_scores(blocks, _vectors(spark, sf_dir), _wanted(spark, sf_dir)), 90)
    return R.fuse(best, near, blocks)


@query("hybrid_fuse", f"WITH {_FUSED} SELECT doc_id, {ROUND} FROM fu")
def hybrid_fuse(spark, sf_dir):
    return ranked(_fused(spark, sf_dir), "doc_id", "score")


@query("hybrid_topk", _hybrid_sql())
def hybrid_topk(spark, sf_dir):
    from corvine.plans.engine import Engine
    from corvine.schema import Request

    engine = Engine(document_blocks(spark, sf_dir), _vectors(spark, sf_dir), lambda _: _wanted(spark, sf_dir))
    return ranked(engine.search(Request("the of", limit=10)), "doc_id", "score")


@query(
    "hybrid_many",
    f"SELECT CAST(0 AS BIGINT) AS request, doc_id, score FROM ({_hybrid_sql()}) UNION ALL SELECT 1, doc_id, score FROM ({_hybrid_sql('src1')})",
)
def hybrid_many(spark, sf_dir):
    from corvine.plans.engine import Engine
    from corvine.schema import Request

    engine = Engine(document_blocks(spark, sf_dir), _vectors(spark, sf_dir), lambda _: _wanted(spark, sf_dir))
    return ranked(engine.search_many([Request("the of"), Request("the of", path="src1")]), "request", "doc_id", "score")


@query("hybrid_degraded", _doc_top("the of", "true", 30) .replace("LIMIT 30", "LIMIT 10"))
def hybrid_degraded(spark, sf_dir):
    from corvine.plans.engine import Engine
    from corvine.schema import Request

    return ranked(Engine(document_blocks(spark, sf_dir)).search(Request("the of", limit=10)), "doc_id", "score")


@query(
    "l2_normalize",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))), 6) AS s FROM embeddings""",
)
def l2_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", S.l2_normalise(F.col("embedding")).alias("e"))
    return v.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query(
    "mean_pool",
    """SELECT label, i, round(avg(x), 6) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL""",
)
def mean_pool(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", F.col("i").cast("bigint").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))


_LINES = r"""ln AS (SELECT conv_id, turn, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS ls FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\r?\n') AS p FROM conversations))"""


@query("line_split", f"WITH {_LINES} SELECT conv_id, turn, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(ls[1], '') AS head FROM ln")
def line_split(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.lines("text").alias("ls"))
    return rows.select("conv_id", "turn", F.size("ls").cast("bigint").alias("n_lines"), F.coalesce(F.get("ls", F.lit(0)), F.lit("")).alias("head"))


@query("line_slice", f"WITH {_LINES} SELECT conv_id, turn, array_to_string(ls[2:3], chr(10)) AS part FROM ln")
def line_slice(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.line_slice("text", F.lit(2), F.lit(3)).alias("part"))


_CONTEXT = f"""{_LINES}, ex AS (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM ln),
    m AS (SELECT *, contains(lower(line), 'the') AS hit FROM ex),
    w AS (SELECT *, max(hit) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS shown,
                    max(hit) OVER (PARTITION BY conv_id, turn) AS any_hit FROM m),
    k AS (SELECT *, lag(i) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM w WHERE shown)"""


@query("context_window", f"WITH {_CONTEXT} SELECT conv_id, turn, i, line FROM k")
def context_window(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(X.lines("text")).alias("i", "line"))
    by = Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(-1, 1)
    shown = F.max(F.contains(F.lower("line"), F.lit("the"))).over(by)
    return rows.withColumn("shown", shown).where("shown").select("conv_id", "turn", (F.col("i") + 1).cast("bigint").alias("i"), "line")


@query(
    "context_gaps",
    f"""WITH {_CONTEXT}, s AS (SELECT conv_id, turn, string_agg(CASE WHEN before IS NOT NULL AND before < i - 1 THEN '  ...' || chr(10) ELSE '' END || line, chr(10) ORDER BY i) AS t FROM k GROUP BY ALL)
    SELECT c.conv_id, c.turn, coalesce(s.t, c.text) AS snippet FROM conversations c LEFT JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn""",
)
def context_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.snippet("text", F.array(F.lit("the")), 1).alias("snippet"))


@query("result_ordinal", f"WITH x AS ({_doc_top('the thing', 'true', 10)}) SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS ordinal, doc_id FROM x")
def result_ordinal(spark, sf_dir):
    best = bm25_topk(spark, sf_dir)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("bigint").alias("ordinal"), "doc_id")


@query(
    "search_results",
    f"""WITH {DOCS}, {bm25_sql('docs', ['the', 'thing'], 'true', _doc_boost('the thing'))},
    cap AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, line) AS k FROM sc),
    best AS (SELECT * FROM cap WHERE k <= 3 ORDER BY score DESC, file_path, line LIMIT 10)
    SELECT row_number() OVER (ORDER BY score DESC, file_path, line) AS ordinal, doc_id, md5(content) AS digest FROM best""",
)
def search_results(spark, sf_dir):
    from corvine.plans.engine import Engine
    from corvine.schema import Request

    found = Engine(document_blocks(spark, sf_dir)).results(Request("the thing", limit=10))
    return found.select("ordinal", "doc_id", F.md5("snippet").alias("digest"))


_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)"


def changes(spark, sf_dir) -> DataFrame:
    return as_changes(table(spark, sf_dir, "events"))


def wall_micros(ts: str) -> Column:
    """Microseconds since 1970 by the clock, of a timestamp with or without a zone."""
    minutes = F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def as_changes(events: DataFrame) -> DataFrame:
    """events as changes of files: the file of a user holds the last event as an XML element."""
    element = F.concat(
        F.lit('<e id="'), F.col("event_id").cast("string"), F.lit('" value="'), F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit('"/>')
    )
    return events.select(
        (wall_micros("ts").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("event_id")).cast("decimal(38,0)").alias("seq"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit(".xml")).alias("path"),
        F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"),
        element.cast("binary").alias("content"),
        "ts",
    )


def user_of(path: str) -> Column:
    return F.regexp_extract(path, r"^/u/(.*)\.xml$", 1)


def scratch(spark, name: str) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="corvine-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("latest_per_key", f"WITH {_LATEST} SELECT CAST(user_id AS VARCHAR) AS path, CASE event_type WHEN 'error' THEN 'remove' ELSE 'upsert' END AS op, event_id FROM l")
def latest_per_key(spark, sf_dir):
    from corvine.streaming.updater import newest

    event = F.regexp_extract(F.col("content").cast("string"), 'id="([0-9]+)"', 1).cast("bigint")
    return newest(changes(spark, sf_dir)).select(user_of("path").alias("path"), "op", event.alias("event_id"))


def before_and_after(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log up to the time at which about half of the paths have their newest change, and what follows. The time
    is one number, found once: an approximate percentile may differ from run to run, and halves cut at different
    times lose the changes between them."""
    newest = log.groupBy("path").agg(F.max(wall_micros("ts")).alias("at"))
    at = newest.agg(F.percentile_approx("at", 0.5)).first()[0]
    later = F.coalesce(wall_micros("ts") > F.lit(at), F.lit(False))
    return log.where(~later), log.where(later)


def updated_index(spark, log: DataFrame, embedder=None):
    """An index of the files as they are before a time, with the changes after it applied."""
    from corvine.plans.index import Index
    from corvine.streaming.updater import newest

    before, after = before_and_after(log)
    index = Index(spark, scratch(spark, "index"), embedder, buckets=4)
    index.build(newest(before).where("op = 'upsert'").select("path", "content"))
    index.apply(newest(after))
    return index


def users(index) -> DataFrame:
    """path, event_id and value of the indexed elements."""
    value = F.nullif(F.regexp_extract("signature", 'value="([^"]*)"', 1), F.lit("")).cast("double")
    return index.blocks().select(user_of("file_path").alias("path"), F.col("name").cast("bigint").alias("event_id"), value.alias("value"))


@query("upsert_apply", f"WITH {_LATEST} SELECT CAST(user_id AS VARCHAR) AS path, event_id, value FROM l WHERE event_type <> 'error'")
def upsert_apply(spark, sf_dir):
    return users(updated_index(spark, changes(spark, sf_dir)))


@query("remove_apply", f"WITH {_LATEST} SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events WHERE user_id NOT IN (SELECT user_id FROM l WHERE event_type = 'error')")
def remove_apply(spark, sf_dir):
    """All files are indexed once; then those go whose newest change is a removal."""
    from corvine.plans.index import Index
    from corvine.streaming.updater import newest

    log = changes(spark, sf_dir)
    index = Index(spark, scratch(spark, "index"), buckets=4)
    index.build(newest(log.withColumn("op", F.lit("upsert"))).select("path", "content"))
    index.apply(newest(log).where("op = 'remove'"))
    return index.files().select(user_of("path").alias("path"))


@query("ignore_ext", r"SELECT page_id, url, coalesce(regexp_extract(split_part(url, '/', -1), '^.+\.([^.]*)$', 1), '') NOT IN ('html', 'png', 'pdf') AS kept FROM pages")
def ignore_ext(spark, sf_dir):
    kept = ~F.coalesce(X.extension("url"), F.lit("")).isin("html", "png", "pdf")
    return table(spark, sf_dir, "pages").select("page_id", "url", kept.alias("kept"))


_REL = r"regexp_replace(url, '^[a-z]+://', '')"
_RULES = ["*.org*", "!keep*", "page/", "page/1", "a"]


@query(
    "ignore_rules",
    rf"""WITH p AS (SELECT page_id, {_REL} AS rel, split_part({_REL}, '/', -1) AS name FROM pages)
    SELECT page_id, CASE WHEN name = 'a' THEN true
      WHEN starts_with(rel, 'page/1') OR contains(rel, '/page/1') THEN true
      WHEN starts_with(name, 'keep') THEN false WHEN regexp_matches(name, '(?s)^.*\.org') THEN true ELSE false END AS ignored FROM p""",
)
def ignore_rules(spark, sf_dir):
    from corvine.sources.ignore import ignored, parse_rules

    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", ignored(parse_rules("\n".join(_RULES)), rel, F.lit(False)).alias("ignored"))


@query("glob", r"SELECT page_id, regexp_matches(url, '(?s)^http.*1$') AS one, regexp_matches(url, '(?s)^.*e.*1') AS many, url = 'x' AS none FROM pages")
def glob(spark, sf_dir):
    from corvine.sources.ignore import glob_column

    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", glob_column("http*1", u).alias("one"), glob_column("*e*1", u).alias("many"), glob_column("x", u).alias("none")
    )


@query(
    "extension_dispatch",
    r"""SELECT coalesce(nullif(regexp_extract(split_part(url, '/', -1), '^.+\.([^.]*)$', 1), ''), 'none') AS ext, count(*) AS n FROM pages GROUP BY 1""",
)
def extension_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.coalesce(X.extension("url"), F.lit("none")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "section_extract",
    """WITH a AS (SELECT page_id, html, strpos(html, '<title') AS p FROM pages), b AS (SELECT *, p + strpos(substr(html, p), '>') AS s FROM a WHERE p > 0),
    c AS (SELECT *, strpos(substr(html, s), '</title>') AS e FROM b)
    SELECT page_id, substr(html, s, e - 1) AS content, len(substr(html, 1, s - 1)) - len(replace(substr(html, 1, s - 1), chr(10), '')) + 1 AS start_line FROM c WHERE e > 0""",
)
def section_extract(spark, sf_dir):
    from corvine.sources.sections import section

    found = table(spark, sf_dir, "pages").select("page_id", section(F.col("html"), "title").alias("s"))
    return found.where("s IS NOT NULL").select("page_id", "s.content", F.col("s.start_line").cast("bigint").alias("start_line"))


@query("offset_to_line", "SELECT page_id, CAST(len(left(html, 200)) - len(replace(left(html, 200), chr(10), '')) + 1 AS BIGINT) AS line FROM pages")
def offset_to_line(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.offset_line(F.col("html"), F.lit(200)).cast("bigint").alias("line"))


_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(
    "sql_dependencies",
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
    t AS (SELECT doc_id, list_filter(list_transform(range(2, len(ws) + 1), lambda i: CASE WHEN upper(ws[i - 1]) IN ('IN', 'OF')
      THEN regexp_replace(ws[i], '^[^\p{{L}}\p{{N}}_.]+|[^\p{{L}}\p{{N}}_.]+$', '', 'g') END), lambda x: x IS NOT NULL AND x <> '' AND upper(x) NOT IN {X.SQL_KEYWORDS}) AS d FROM w)
    SELECT doc_id, array_to_string(d, ',') AS tables, CAST(len(d) AS BIGINT) AS n FROM t""",
)
def sql_dependencies(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", X.sql_dependencies("text", ("IN", "OF")).alias("d"))
    return found.select("doc_id", F.array_join("d", ",").alias("tables"), F.size("d").cast("bigint").alias("n"))


@query("param_refs", r"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(replace(text, ' the ', ' #{the} '), '#\{([^}]*)\}', 1), lambda x: x <> ''), lambda x: 'param:' || x), ',') AS params FROM documents")
def param_refs(spark, sf_dir):
    text = F.regexp_replace("text", " the ", " #{the} ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.parameters(text), ",").alias("params"))


@query(
    "block_last_of_key",
    f"""WITH {CONV} SELECT file_path, start_line, end_line, name FROM (SELECT *, row_number() OVER (PARTITION BY file_path, start_line, end_line
      ORDER BY score DESC, kind, name) AS k FROM (SELECT file_path, start_line // 3 AS start_line, 0 AS end_line, kind, name, len(content) AS score FROM conv)) WHERE k = 1""",
)
def block_last_of_key(spark, sf_dir):
    """Of blocks that share a key (here: three lines each), the best."""
    rows = conversation_blocks(spark, sf_dir).withColumns(
        {"start_line": F.floor(F.col("start_line") / 3).cast("int"), "end_line": F.lit(0), "score": F.length("content").cast("double")}
    )
    return ranked(R.best_per_key(rows), "file_path", "start_line", "end_line", "name")


@query("file_counts", f"WITH {CONV} SELECT count(DISTINCT file_path) AS files, count(*) AS blocks, count(DISTINCT (file_path, start_line, end_line)) AS keys FROM conv")
def file_counts(spark, sf_dir):
    rows = conversation_blocks(spark, sf_dir)
    return rows.agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("blocks"), F.countDistinct("file_path", "start_line", "end_line").alias("keys"))


_CHANGE_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query("stream_upsert_final", f"WITH {_LATEST} SELECT CAST(user_id AS VARCHAR) AS path, event_id, value FROM l WHERE event_type <> 'error'")
def stream_upsert_final(spark, sf_dir):
    """The change log as a stream into an index; the result is what the index holds in the end. Without a bound on
    files a trigger takes all that is there, in which the newest change of a path is found by time."""
    from corvine.plans.index import Index
    from corvine.streaming.updater import apply_batch

    folder = scratch(spark, "stream")
    index = Index(spark, f"{folder}/index", buckets=4)
    log = spark.readStream.schema(_CHANGE_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    body = apply_batch(index)
    q = (
        log.writeStream.foreachBatch(lambda batch, n: body(as_changes(batch), n))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return users(index)


@query("stream_upsert_batches", ORACLE["stream_upsert_final"])
def stream_upsert_batches(spark, sf_dir):
    """The same log dealt over files without regard to time, and taken a file at a time: late changes of a path come
    after newer ones."""
    from corvine.plans.index import Index
    from corvine.streaming.updater import apply_batch

    folder = scratch(spark, "stream")
    events = table(spark, sf_dir, "events")
    events.repartition(4, "event_id").write.parquet(f"{folder}/log")
    index = Index(spark, f"{folder}/index", buckets=4)
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    body = apply_batch(index)
    q = (
        log.writeStream.foreachBatch(lambda batch, n: body(as_changes(batch), n))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return users(index)


_STATE = "SELECT user_id, max(event_id) AS modified, count(*) AS size FROM events WHERE event_type <> '{}' GROUP BY user_id HAVING max(value) {}"


@query(
    "snapshot_difference",
    f"""WITH a AS ({_STATE.format('view', '< 250')}), b AS ({_STATE.format('error', '> 120')})
    SELECT CAST(coalesce(a.user_id, b.user_id) AS VARCHAR) AS path, CASE WHEN b.user_id IS NULL THEN 'remove' ELSE 'upsert' END AS op
    FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.size IS DISTINCT FROM b.size OR a.modified IS DISTINCT FROM b.modified""",
)
def snapshot_difference(spark, sf_dir):
    """What differs between two states of the users' files, made of different events; some users are in one only."""
    from corvine.streaming.tree import difference

    def state(without: str, having: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").where(F.col("event_type") != without).groupBy(F.col("user_id").cast("string").alias("path"))
        return rows.agg(F.count(F.lit(1)).alias("size"), F.max("event_id").alias("modified"), F.max("value").alias("most")).where(having)

    return difference(state("view", "most < 250"), state("error", "most > 120"))


@query(
    "blocks_function",
    """WITH e AS (SELECT *, '<e id="' || event_id || '" type="' || event_type || '"/>' AS content FROM events WHERE event_type <> 'error')
    SELECT event_id, kind, name, start_line, end_line, signature, content FROM (
      SELECT event_id, 'XmlNode' AS kind, CAST(event_id AS VARCHAR) AS name, CAST(2 AS BIGINT) AS start_line, CAST(2 AS BIGINT) AS end_line, content AS signature, content FROM e
      UNION ALL SELECT event_id, 'XmlNode', 'r' || event_id, 1, 1, '<r id="r' || event_id || '">', '<r id="r' || event_id || '">' FROM e)""",
)
def blocks_function(spark, sf_dir):
    """Every event as a file, parsed by the table function in SQL; those of errors do not parse and give no row."""
    from corvine.plans.index import register_blocks_function

    name = "code_blocks_" + scratch(spark, "f").rsplit("-", 1)[1]
    register_blocks_function(spark, name)
    number, end = F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", "</x>").otherwise("</r>")
    inner = F.concat(F.lit('<e id="'), number, F.lit('" type="'), F.col("event_type"), F.lit('"/>'))
    content = F.concat(F.lit('<r id="r'), number, F.lit('">\n'), inner, F.lit("\n"), end).cast("binary")
    files = table(spark, sf_dir, "events").select("event_id", F.lit("/e.xml").alias("path"), content.alias("content"))
    rows = spark.sql(f"SELECT f.event_id, b.* FROM {{files}} f, LATERAL {name}(f.path, f.content) b", files=files)
    return ranked(rows, "event_id", "kind", "name", "start_line", "end_line", "signature", "content")


@query(
    "index_state",
    f"""WITH {_LATEST} SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'parsed' END AS status, count(*) AS files,
      CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS BIGINT) AS blocks FROM l GROUP BY 1""",
)
def index_state(spark, sf_dir):
    """What an index says of its files, when those whose newest event is an error do not parse."""
    from corvine.plans.index import Index
    from corvine.streaming.updater import newest

    index = Index(spark, scratch(spark, "index"), buckets=4)
    broken = F.when(F.col("op") == "remove", F.lit("</broken>").cast("binary")).otherwise(F.col("content"))
    index.build(newest(changes(spark, sf_dir)).select("path", broken.alias("content")))
    status = F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("status")
    said = index.files().groupBy(status).agg(F.count(F.lit(1)).alias("files"))
    # counted on the blocks themselves, not on what the files say of them
    own = index.files().join(index.blocks().groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")), "path", "left")
    return said.join(own.groupBy(status).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blocks")), "status")


@query("vectors_follow", f"WITH {_LATEST} SELECT CAST(user_id AS VARCHAR) AS path, CAST(1 AS BIGINT) AS start_line, CAST(1 AS BIGINT) AS end_line, CAST(1 AS DOUBLE) AS norm FROM l WHERE event_type <> 'error'")
def vectors_follow(spark, sf_dir):
    """The vectors of an index after an update: one of unit length for each block that is there."""
    from corvine.plans.embedders import HashingEmbedder

    vectors = updated_index(spark, changes(spark, sf_dir), HashingEmbedder(16)).vectors()
    norm = F.round(F.sqrt(S.dot(F.col("embedding"), F.col("embedding"))), 4)
    return ranked(vectors.withColumns({"path": user_of("file_path"), "norm": norm}), "path", "start_line", "end_line", "norm")


@query(
    "rendered_results",
    f"""WITH {DOCS}, {bm25_sql('docs', ['the', 'thing'], 'true', _doc_boost('the thing'))},
    cap AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, line) AS k FROM sc),
    best AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_path, line) AS ordinal FROM cap WHERE k <= 3)
    SELECT ordinal, '--- Result ' || ordinal || ' (score: ' || printf('%.2f', score) || ') ---' || chr(10) || 'File: ' || file_path || '  Lines: ' || line || '-' || line
      || chr(10) || 'Kind: Other  Name: ' || name || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) AS shown FROM best WHERE ordinal <= 10""",
)
def rendered_results(spark, sf_dir):
    """The results of a search as the text that a caller gets, ten rows."""
    from corvine.plans.engine import Engine, render_row
    from corvine.schema import Request

    rows = Engine(document_blocks(spark, sf_dir)).results(Request("the thing")).collect()
    return spark.createDataFrame([(r["ordinal"], render_row(r)) for r in rows], "ordinal bigint, shown string")


_PLACES = ["src", "node_modules", "a/build/b", "target", "src/out.d", ".git/x", "lib"]
_ENDS = ["java", "jar", "png", "xml", "lock", "PNG", "tar.gz"]


@query(
    "excluded_paths",
    rf"""WITH p AS (SELECT page_id, list_extract({_PLACES}, 1 + CAST(len(url) % 7 AS INT)) || '/' || {_REL} || '.' || list_extract({_ENDS}, 1 + CAST(len(html) % 7 AS INT)) AS rel FROM pages),
    n AS (SELECT page_id, rel, string_split(rel, '/') AS parts FROM p)
    SELECT page_id, list_has_any(parts[1:len(parts) - 1], ['node_modules', 'build', 'target', '.git'])
      OR list_contains(['jar', 'png', 'lock', 'gz'], regexp_extract(parts[len(parts)], '^.+\.([^.]*)$', 1)) AS excluded FROM n""",
)
def excluded_paths(spark, sf_dir):
    """The built-in names and extensions, on the pages' addresses in some folders and with some extensions."""
    from corvine.sources.scan import is_excluded

    some = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.length(n) % 7 + 1).cast("int"))
    rel = F.concat(some(_PLACES, "url"), F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("."), some(_ENDS, "html"))
    return table(spark, sf_dir, "pages").select("page_id", is_excluded([], rel).alias("excluded"))


#: Sources for the parsers' queries, one of each for every document; # stands for its doc_id. With each, the rows
#: that it has to give: lines, kind, name, parent, signature, annotations, dependencies, and the length of
#: the content without the doc_ids in it and how many these are.
SOURCES = {
    "java": (
        "import a.b.D#;\n@Svc\npublic class C# extends Base implements Run {\n  private int n# = 1;\n  C#() { }\n  int f#(int x) { return g(x); }\n}\n",
        """(1, 1, 'Import', 'a.b.D#', NULL, NULL, '', '', 13, 1),
        (2, 7, 'Class', 'C#', NULL, '@Svc' || chr(10) || 'public class C# extends Base implements Run', '@Svc', 'extends Base,implements Run', 114, 4),
        (4, 4, 'Field', 'n#', 'C#', 'private int n# = 1', '', '', 18, 1),
        (5, 5, 'Constructor', 'C#', 'C#', 'C# () { }', '', '', 7, 1),
        (6, 6, 'Method', 'f#', 'C#', 'int f# (int x)', '', '', 29, 1)""",
    ),
    "ts": (
        "import { q } from './m#';\nexport interface S# { a: string }\nexport class T# extends U {\n  v: number = 1;\n  m#(a: string): void { }\n}\n"
        "export function f#(x) { return x; }\nconst g# = (x) => x;\n",
        """(1, 1, 'Import', './m#', NULL, NULL, '', '', 24, 1),
        (2, 2, 'Interface', 'S#', NULL, 'interface S#', '', '', 32, 1),
        (3, 6, 'Class', 'T#', NULL, 'class T# extends U', '', 'extends U', 70, 2),
        (4, 4, 'Field', 'v', 'T#', 'v: number = 1', '', '', 13, 0),
        (5, 5, 'Method', 'm#', 'T#', 'm# (a: string) : void', '', '', 22, 1),
        (7, 7, 'Method', 'f#', NULL, 'function f# (x)', '', '', 34, 1),
        (8, 8, 'Method', 'g#', NULL, 'g# = (x) => ...', '', '', 19, 1)""",
    ),
    "vue": (
        "<template>\n<p/>\n</template>\n<script setup>\nconst e# = defineEmits(['x'])\nfunction go#() { }\n</script>\n",
        """(1, 3, 'Other', 'template', NULL, NULL, '', '', 6, 0),
        (5, 5, 'Other', 'defineEmits', NULL, 'const e# = defineEmits([''x''])', '', '', 28, 1),
        (6, 6, 'Method', 'go#', NULL, 'function go# ()', '', '', 17, 1)""",
    ),
    "xml": (
        '<r id="r#">&nbsp;\n<s name="a&amp;#"/>\n<t>\n<u/></t></r><z/>',
        """(1, 1, 'XmlNode', 'r#', NULL, '<r id="r#">', '', '', 16, 1),
        (2, 2, 'XmlNode', 'a&amp;#', NULL, '<s name="a&amp;#"/>', '', '', 18, 1),
        (3, 3, 'XmlNode', 't', NULL, '<t>', '', '', 3, 0),
        (4, 4, 'XmlNode', 'z', NULL, '<z/>', '', '', 16, 0)""",
    ),
    "mapper.xml": (
        '<mapper namespace="n#">\n<select id="q#">\nSELECT * FROM t# JOIN u<b/>\nWHERE a = %{p}\n</select>\n<sql id="s#">x</sql>\n</mapper>',
        """(1, 1, 'XmlNamespace', 'n#', NULL, 'namespace: n#', '', '', 22, 1),
        (2, 5, 'XmlNode', 'q#', 'n#', '<select id="q#">', '', 't#,u,param:p', 67, 2),
        (6, 6, 'XmlNode', 's#', 'n#', '<sql id="s#">', '', '', 19, 1)""",
    ),
}


def _parsed(spark, sf_dir, ending: str) -> DataFrame:
    from corvine.plans.index import blocks_of, parse_files

    number = F.col("doc_id").cast("string")
    content = F.replace(F.replace(F.lit(SOURCES[ending][0]), F.lit("#"), number), F.lit("%{"), F.lit("#{"))
    path = F.concat(F.lit("/s/"), number, F.lit("." + ending))
    blocks = blocks_of(parse_files(table(spark, sf_dir, "documents").select(path.alias("path"), content.cast("binary").alias("content"))))
    listed = blocks.withColumns(
        {"annotations": F.array_join("annotations", ","), "dependencies": F.array_join("dependencies", ","), "n_chars": F.length("content")}
    )
    return ranked(listed, "file_path", "start_line", "end_line", "kind", "name", "parent", "signature", "annotations", "dependencies", "n_chars")


def _parsed_sql(ending: str) -> str:
    put = lambda c: f"replace({c}, '#', CAST(doc_id AS VARCHAR)) AS {c}"
    return f"""SELECT '/s/' || doc_id || '.{ending}' AS file_path, start_line, end_line, kind, {put('name')}, {put('parent')}, {put('signature')},
      annotations, {put('dependencies')}, n + times * len(CAST(doc_id AS VARCHAR)) AS n_chars
    FROM documents, (VALUES {SOURCES[ending][1]}) v(start_line, end_line, kind, name, parent, signature, annotations, dependencies, n, times)"""


for _ending, _name in (("java", "parse_java"), ("ts", "parse_js"), ("vue", "parse_vue"), ("xml", "parse_xml"), ("mapper.xml", "parse_mapper")):
    query(_name, _parsed_sql(_ending))(lambda spark, sf_dir, e=_ending: _parsed(spark, sf_dir, e))


@query("embed_documents")
def embed_documents(spark, sf_dir):
    """Vectors of all documents by the embedder that needs no model."""
    from corvine.plans.embedders import HashingEmbedder
    from corvine.plans.index import embed_blocks

    return embed_blocks(document_blocks(spark, sf_dir), HashingEmbedder(64))

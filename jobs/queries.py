"""The jobs as queries over the given tables, with DuckDB SQL: each runs twice into one new folder, and the result is what
the second run leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.plans.catalogue import tokens_sql
from jobs import answer_requests as answer
from jobs import index_documents as index
from jobs.common import defaults, new_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


@query(
    "job1_index_documents",
    f"""
    WITH d AS (SELECT doc_id, lang, source, {tokens_sql("coalesce(text, '')")} AS tokens, list_distinct({tokens_sql("lower(coalesce(text, ''))")}) AS words FROM documents),
    a AS (SELECT doc_id, unnest(tokens) AS term, 1 AS t, 0 AS h FROM d UNION ALL SELECT doc_id, unnest(words), 0, 1 FROM d),
    p AS (SELECT doc_id, term, CAST(sum(t) AS BIGINT) AS tf, max(h) = 1 AS held FROM a GROUP BY ALL)
    SELECT doc_id, lang, source, CAST(len(tokens) AS BIGINT) AS n_tokens, term, tf, held FROM p JOIN d USING (doc_id)
    """,
)
def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    for _ in range(2):  # the second run finds nothing new
        index.index_documents(spark, f"{sf_dir}/documents.parquet*", f"{folder}/index", f"{folder}/checkpoint", defaults("index_documents"))
    return index.current_postings(spark, f"{folder}/index").withColumn("tf", F.col("tf").cast("bigint"))


@query(
    "job2_answer_requests",
    f"""
    WITH docs AS (SELECT doc_id, source, 'doc_' || doc_id AS name, {tokens_sql("concat_ws(' ', 'doc_' || doc_id, text)")} AS tokens,
      list_distinct(list_concat({tokens_sql("lower(text)")}, {tokens_sql("'doc_' || doc_id")})) AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS word FROM docs),
    q AS (SELECT item_id, lower(text) AS query, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos
          FROM (SELECT item_id, text, {tokens_sql("text")} AS terms FROM benchmark)),
    t AS (SELECT DISTINCT term FROM q),
    tw AS (SELECT term, word FROM t JOIN (SELECT DISTINCT word FROM w) ON contains(word, term)),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tw JOIN w USING (word) GROUP BY term),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) WHERE term IN (FROM t) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(len(tokens)) AS average FROM docs),
    p AS (SELECT item_id, query, pos, doc_id, source, name, greatest(ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1), 0) * (tf * 2.5)
            / (tf + 1.5 * (1 - 0.75 + 0.75 * len(tokens) / average)) AS part
          FROM q JOIN tf USING (term) LEFT JOIN df USING (term) JOIN docs USING (doc_id), st),
    s AS (SELECT item_id, query, doc_id, source, name, list_reduce(list(part ORDER BY pos), lambda a, b: a + b)
            * CASE WHEN name = query THEN 2.0 WHEN contains(name, query) THEN 1.5 ELSE 1.0 END AS score FROM p GROUP BY item_id, query, doc_id, source, name),
    c AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source, doc_id) AS ordinal FROM c WHERE k <= 3)
    SELECT item_id, ordinal, doc_id, source, round(score, 6) AS score FROM o WHERE ordinal <= 10
    """,
)
def job2_answer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        answer.answer_requests(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder, defaults("answer_requests"))
    return answer.results(spark, folder).withColumn("score", F.round("score", 6))

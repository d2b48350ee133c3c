"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvine.llm.textkit import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.bpe import token_digests

    return token_digests(read_table(spark, sf_dir, "documents"), vocabulary())


@query("op1_lz_fingerprint")
def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.fingerprint import followed

    return followed(read_table(spark, sf_dir, "documents"))


@query(
    "op4_exact_dedup",
    """
    WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size
               FROM documents GROUP BY 1)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
    FROM documents d JOIN g ON coalesce(d.text, '') = g.t
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.exact import mark_copies

    return mark_copies(read_table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.langid import identify_held_out

    return identify_held_out(read_table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.toxicity import score_held_out

    return score_held_out(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query(
    "op9_difference_cover",
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
               FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM s),
    m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
    hit AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.t = m.t AND m.least < w.doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
    g AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN g.n IS NULL THEN ws
                  ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(js, j)), lambda j: ws[j]) END, ' '))
           AS kept_sha256
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id
    """,
)
def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.coveranchors import remove_passages

    return remove_passages(read_table(spark, sf_dir, "documents"))


@query(
    "op7_bottom_k",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    sh AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5
             THEN list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' ')))
             WHEN len(ws) > 0 THEN [hash(array_to_string(ws, ' '))] ELSE [] END)) AS s FROM d),
    c AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sh WHERE len(s) > 0 GROUP BY s),
    e AS (SELECT id, n, unnest(s) AS v FROM c),
    o AS (SELECT a.id AS x, b.id AS y, a.n AS nx, b.n AS ny, count(*) AS i FROM e a JOIN e b ON a.v = b.v AND a.id < b.id
          WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
    l AS (SELECT x, y FROM o WHERE 100 * i >= 85 * (nx + ny - i)),
    u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT id AS node, id AS reach FROM c UNION SELECT r.node, u.y FROM r JOIN u ON r.reach = u.x),
    m AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
    SELECT sh.doc_id, CAST(len(sh.s) AS BIGINT) AS n_shingles, coalesce(m.component, sh.doc_id) AS component_id,
           sh.doc_id = coalesce(m.component, sh.doc_id) AS kept
    FROM sh LEFT JOIN c ON sh.s = c.s LEFT JOIN m ON c.id = m.node
    """,
)
def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.bottomk import group_near_copies

    return group_near_copies(read_table(spark, sf_dir, "documents"))


@query(
    "op6_run_index",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    s AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200),
    w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS t FROM s),
    m AS (SELECT t, min({'a': doc_id, 'b': i}) AS least FROM w GROUP BY t HAVING count(*) > 1),
    hit AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.t = m.t WHERE {'a': w.doc_id, 'b': w.i} > m.least),
    e AS (SELECT doc_id, i, i + 100 AS j, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit),
    k AS (SELECT *, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e),
    r AS (SELECT doc_id, g, min(i) AS a, max(j) AS b FROM k GROUP BY doc_id, g),
    q AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM r),
    p AS (SELECT q.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
                 string_agg(CASE WHEN n = 1 THEN substr(x, 1, 2 * a) ELSE '' END || substr(x, 2 * b + 1, 2 * (coalesce(nxt, len(x) // 2) - b)), '' ORDER BY a) AS kept
          FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
    SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
    FROM d LEFT JOIN p ON d.doc_id = p.doc_id
    """,
)
def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.runindex import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


MIX_WEIGHTS = {"domain": {"d0": 1, "d1": 4, "d2": 3, "d3": 2}, "lang": {"en": 5, "de": 3, "fr": 3, "es": 2}}
MIX_SHARE = 0.7

_LEVEL = """
    n{k} AS (SELECT {cols}, sum(capacity) AS capacity, {weight} AS weight FROM lf GROUP BY {cols}),
    b{k} AS (SELECT n{k}.*, {budget} AS budget FROM n{k} {join}),
    r{k} AS (SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {level}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY {parent}
                ORDER BY capacity / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM b{k}),
    s{k} AS (SELECT {cols}, CAST(CASE WHEN capacity / weight <= rate THEN capacity ELSE floor(weight *
                max(CASE WHEN capacity / weight > rate THEN rate END) OVER (PARTITION BY {parent})) END AS BIGINT) AS budget FROM r{k}),"""


def _mixing_sql(weights: dict, share: float, epochs: int = 4, seed: int = 17) -> str:
    tree = ["domain", "lang", "source"]
    case = lambda c: "CAST(CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in weights[c].items()) + " ELSE 1 END AS DOUBLE)" if c in weights else "CAST(1 AS DOUBLE)"
    levels = ""
    for k, c in enumerate(tree):
        levels += _LEVEL.format(
            k=k,
            level=c,
            cols=", ".join(tree[: k + 1]),
            parent=", ".join(tree[:k]) or "1",
            weight=case(c),
            budget="(SELECT CAST(floor(sum(n_tokens) * CAST(%s AS DOUBLE)) AS BIGINT) FROM d)" % share if not k else f"s{k - 1}.budget",
            join="" if not k else f"JOIN s{k - 1} USING ({', '.join(tree[:k])})",
        )
    return rf"""
    WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '(\d+)', 1) = '' THEN 'none'
                 ELSE 'd' || (CAST(right(regexp_extract(source, '(\d+)', 1), 1) AS INT) % 4) END AS domain,
               coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
               CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
    lf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {epochs} AS DOUBLE) AS capacity
           FROM d GROUP BY ALL),{levels}
    p AS (SELECT lf.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
                 CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM lf JOIN s2 USING (domain, lang, source)),
    o AS (SELECT d.*, p.epochs, p.rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source
            ORDER BY md5('{seed}:' || p.epochs || ':' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) AS reach
          FROM d JOIN p USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN reach <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o
    """


@query("op8_mixing", _mixing_sql(MIX_WEIGHTS, MIX_SHARE))
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.mixing import domain_of, plan_copies

    docs = read_table(spark, sf_dir, "documents").withColumn("domain", domain_of())
    return plan_copies(docs, MIX_WEIGHTS, MIX_SHARE)


@query("op2_quality_cotraining")
def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.cotrain import score_held_out

    return score_held_out(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op11_runs")
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.runs import run_digests

    return run_digests(read_table(spark, sf_dir, "documents"))


_ENDS = "CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 5 ELSE 20 + len(role) + {role} END"
_MARKS = r"<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>|\[\\*/?ROLE\]|\[\\*/TURN\]"


@query(
    "op12_chat",
    rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
      UNION ALL SELECT -7, k, role, '</s>[INST] ok [/INST]', role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS k FROM c),
    m AS (SELECT *, lag(role, 1, 'assistant') OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
           CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(CASE WHEN before = 'assistant' THEN 3 ELSE 0 END + {_ENDS.format(role="len(regexp_extract_all(role, '" + _MARKS + "'))")}
             + len(text) + len(regexp_extract_all(text, '{_MARKS}'))) AS BIGINT) AS formatted_chars
    FROM m GROUP BY conv_id
    """,
)
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvine.llm.chat import read_back, with_trap

    return read_back(with_trap(spark, read_table(spark, sf_dir, "conversations")))

import random

import pytest
from pyspark.sql import functions as F

from corvine.functions import scoring as S
from corvine.functions import text as X
from corvine.sources.ignore import glob, glob_column, ignored, is_ignored, parse_rules
from corvine.sources.parsers.xml import sql_dependencies


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('com.foo.Bar#baz(int a,b) user_name "q" x=y[0]', ["com", "foo", "bar#baz", "int", "a", "b", "user_name", '"q"', "x=y[0]"]),
        ("a b　c", ["a", "b", "c"]),
        ("", []),
        (" .;,/\\ ", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens("t"), t=text) == want
    assert X.query_terms(text) == want


@pytest.mark.parametrize("text, want", [("a\r\nb\n", ["a", "b"]), ("", []), ("a", ["a"]), ("\n", [""]), ("a\n\nb", ["a", "", "b"])])
def test_lines(spark, text, want):
    assert one(spark, X.lines("t"), t=text) == want


CONTENT = "a\nfoo\nb\nc\nd\nFOO x\ne"


@pytest.mark.parametrize(
    "terms, n, want",
    [
        (["foo"], 1, "a\nfoo\nb\n  ...\nd\nFOO x\ne"),
        (["foo"], 0, "foo\n  ...\nFOO x"),
        (["zz"], 1, CONTENT),
        (["foo"], 9, CONTENT),
        (["e"], 0, "e"),
    ],
)
def test_snippet(spark, terms, n, want):
    assert one(spark, X.snippet("t", F.array(*map(F.lit, terms)), n), t=CONTENT) == want


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT * FROM user u LEFT JOIN `role` r ON u.rid = r.id WHERE u.id = #{id} AND u.n = #{name,jdbcType=VARCHAR}", ["user", "role", "param:id", "param:name,jdbcType=VARCHAR"]),
        ("select * from (select 1) t join t2", ["t2"]),
        ("SELECT 1 FROM", []),
        ("", []),
        ("#{} #{a", []),
    ],
)
def test_sql_dependencies(spark, sql, want):
    assert one(spark, X.sql_dependencies("t"), t=sql) == want
    assert sql_dependencies(sql) == want


@pytest.mark.parametrize(
    "pattern, name, want",
    [("*.log", "a.log", True), ("*.log", "a.log.1", False), ("ab*ba", "aba", False), ("*a*b", "xaybz", True), ("a*b*", "zab", False), ("x", "xy", False), ("a.b", "a.b", True)],
)
def test_glob(spark, pattern, name, want):
    assert glob(pattern, name) is want
    assert one(spark, glob_column(pattern, F.col("t")), t=name) is want


def test_rules(spark):
    rules = parse_rules("# note\n\n*.log\n!keep.log\n/foo\nsrc/ap\ntmp/\n")
    cases = {("a.log", False): True, ("keep.log", False): False, ("foo", False): False, ("src/api/x.js", False): True, ("tmp", True): True, ("tmp", False): False}
    for (path, directory), want in cases.items():
        assert is_ignored(rules, path, directory) is want
        assert one(spark, ignored(rules, F.col("p"), F.col("d")), p=path, d=directory) is want


def test_numbers(spark):
    assert one(spark, S.dot(F.col("a"), F.col("b")), a=[1.0, 2.0, 3.0], b=[2.0, 2.0]) == 6.0
    assert one(spark, S.l2_normalise(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, S.min_max(F.col("s"), F.col("l"), F.col("h")), s=3.0, l=3.0, h=3.0) == 1.0
    assert one(spark, X.offset_line(F.col("t"), F.lit(3)), t="a\nb\nc") == 2
    assert one(spark, X.line_slice("t", F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"
    for path, want in {"/a/b.tar.gz": "gz", "/a/.git": None, "/a/A.JAVA": "JAVA", "/a.b/c": None}.items():
        assert one(spark, X.extension("p"), p=path) == want


def test_snippet_against_a_plain_loop(spark):
    rng = random.Random(3)

    def plain(content, n):
        lines = content.split("\n")
        hits = [i for i, x in enumerate(lines) if "q" in x.lower()]
        shown = [any(abs(i - h) <= n for h in hits) for i in range(len(lines))]
        out = []
        for i, x in enumerate(lines):
            if shown[i]:
                out += ["  ..."] if out and not shown[i - 1] else []
                out.append(x)
        return "\n".join(out) if hits else content

    texts = ["\n".join(rng.choice(["q", "Qa", "b", "c"]) for _ in range(rng.randint(1, 20))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], ["t"])
    for n in (0, 1, 3):
        got = [r["v"] for r in df.select(X.snippet("t", F.array(F.lit("q")), n).alias("v")).collect()]
        assert got == [plain(t, n) for t in texts]

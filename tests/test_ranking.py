"""Hand-worked cases and random comparisons with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corvine.operators import ranking as R
from corvine.plans.engine import Engine, two_decimals
from corvine.schema import BLOCK, KEY, VECTOR, Request

BLOCKS = [
    ("/p/a/UserService.java", 3, 12, "class UserService { User findUser(Long id) { return repo.find(id); } }", "java", "Class", "UserService", None, "class UserService", [], []),
    ("/p/a/UserService.java", 5, 7, "User findUser(Long id) { return repo.find(id); }", "java", "Method", "findUser", "UserService", "User findUser (Long id)", [], []),
    ("/p/a/UserService.java", 1, 1, "import com.x.User;", "java", "Import", "com.x.User", None, None, [], []),
    ("/p/b/user.xml", 4, 9, '<select id="findUser"> SELECT * FROM user WHERE id = #{id} </select>', "xml", "XmlNode", "findUser", "com.x.UserMapper", '<select id="findUser">', [], []),
    ("/p/b/app.js", 1, 3, "function render(user) { return user; }", "javascript", "Method", "render", None, "function render (user)", [], []),
]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(BLOCKS, BLOCK).cache()


@pytest.mark.parametrize(
    "query, lang, want",
    [
        ("user", None, {"UserService": 0.422587, "findUser5": 0.231414, "com.x.User": 0.086421, "findUser4": 0.129019, "render": 0.201754}),
        ("findUser", None, {"UserService": 1.047095, "findUser5": 3.378848, "findUser4": 1.065619}),
        ("find id", None, {"UserService": 2.555296, "findUser5": 1.783353, "findUser4": 0.801514}),
        ("user", ["java"], {"UserService": 0.626216, "findUser5": 0.345825, "com.x.User": 0.130493}),
        ("  ", None, {}),
        ("user", [""], {}),
    ],
)
def test_bm25(blocks, query, lang, want):
    rows = R.bm25_scores(R.keep_languages(blocks, lang), query).collect()
    got = {r["name"] + (str(r["start_line"]) if r["name"] == "findUser" else ""): round(r["score"], 6) for r in rows}
    assert got == want


def test_outermost_wins_over_a_better_score(blocks):
    rows = Engine(blocks).search(Request("findUser")).collect()
    assert [(r["name"], round(r["score"], 6)) for r in rows] == [("findUser", 1.065619), ("UserService", 1.047095)]


def test_path_is_a_part_of_the_file_path(blocks):
    rows = Engine(blocks).search(Request("user", path="p/b")).collect()
    assert {r["file_path"] for r in rows} == {"/p/b/user.xml", "/p/b/app.js"}


@pytest.mark.parametrize("lines", [1, 7, 50, 10_000])
def test_outermost_in_parts(spark, lines):
    rng = random.Random(lines)
    rows = []
    for i in range(1500):
        start = rng.randint(0, 300)
        rows.append((rng.randint(0, 1), rng.choice(["/a", "/b", None]), start, start + rng.choice([0, 1, 3, 40, 250]), rng.choice(["K", "L"]), f"n{i}", rng.random()))
    df = spark.createDataFrame(rows, "request int, file_path string, start_line int, end_line int, kind string, name string, score double").where("file_path IS NOT NULL")
    for by in ((), ("request",)):
        whole = sorted(map(tuple, R.outermost(df, by=by).collect()))
        assert sorted(map(tuple, R.outermost_in_parts(df, lines, by=by).collect())) == whole
    plan = R.outermost_in_parts(df, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "[file_path#" in plan and "__part" in plan.split("Window")[1]


def greedy(rows):
    kept = []
    for r in rows:
        if any(k[0] <= r[0] and k[1] >= r[1] for k in kept):
            continue
        kept = [k for k in kept if not (r[0] <= k[0] and r[1] >= k[1])] + [r]
    return set(kept)


def test_overlap_against_the_greedy_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for f in range(60):
        ranges = [(a, a + rng.randint(0, 6)) for a in (rng.randint(1, 12) for _ in range(rng.randint(1, 8)))]
        ranges = list(dict.fromkeys(ranges))
        rows += [(f"f{f}", a, b, "Other", f"n{i}", float(100 - i)) for i, (a, b) in enumerate(ranges)]
        want[f"f{f}"] = greedy(ranges)
    df = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, kind string, name string, score double")
    got = {}
    for r in R.outermost(df).collect():
        got.setdefault(r["file_path"], set()).add((r["start_line"], r["end_line"]))
    assert got == want


def test_cap_and_limit(spark):
    rows = [("f", i, i, "Other", "n", float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, kind string, name string, score double")
    assert [r["score"] for r in R.diversify(df, 10).collect()] == [5.0, 4.0, 3.0]
    assert [r["score"] for r in R.diversify(df, 2).collect()] == [5.0, 4.0]
    with pytest.raises(ValueError):
        R.diversify(df, 2, "middle")


def test_innermost(spark):
    rows = [("f", 1, 10, "Other", "a", 1.0), ("f", 3, 5, "Other", "b", 1.0), ("f", 7, 12, "Other", "c", 1.0)]
    df = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, kind string, name string, score double")
    assert {r["name"] for r in R.innermost(df).collect()} == {"b", "c"}


def test_fusion(spark):
    def block(n):
        return (f"/{n}", 1, 1, n, "java", "Other", n, None, None, [], [])

    blocks = spark.createDataFrame([block(n) for n in "ABCDE"], BLOCK)
    bm = blocks.join(spark.createDataFrame([("A", 9.0), ("B", 6.0), ("C", 3.0)], "name string, score double"), "name")
    near = spark.createDataFrame([("/B", 1, 1, 0.8), ("/D", 1, 1, 0.2), ("/E", 1, 1, -1.0)], "file_path string, start_line int, end_line int, cosine double")
    got = {r["name"]: round(r["score"], 6) for r in R.fuse(bm, near, blocks).collect()}
    assert got == {"A": 0.5, "B": 0.7, "C": 0.0, "D": 0.3, "E": 0.0}
    alone = R.fuse(bm.where("name = 'C'"), near.where("cosine > 1"), blocks).collect()
    assert [r["score"] for r in alone] == [0.5]


def test_hybrid_modes(spark, blocks):
    vectors = spark.createDataFrame([(b[0], b[1], b[2], [1.0, 0.0] if i == 4 else [0.0, 1.0]) for i, b in enumerate(BLOCKS)], VECTOR)
    full = Engine(blocks, vectors, lambda text: [1.0, 0.0])
    assert full.search(Request("   ", limit=1)).collect()[0]["name"] == "render"  # vectors still rank
    assert {r["language"] for r in full.search(Request("user", lang="xml")).collect()} > {"xml"}  # and heed no language

    def broken(text):
        raise RuntimeError

    plain = Engine(blocks).search(Request("user")).collect()
    assert Engine(blocks, vectors, broken).search(Request("user")).collect() == plain
    empty = Engine(blocks, vectors.where("false"), lambda text: [1.0, 0.0]).search(Request("user")).collect()
    assert max(r["score"] for r in empty) == 0.5


def test_same_rows_on_any_number_of_partitions(spark, blocks):
    seen = set()
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str(Engine(blocks.repartition(int(n))).search(Request("user")).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_render(blocks):
    text = Engine(blocks).render(Request("render", context="0"))
    assert text.startswith("--- Result 1 (score: ") and "Kind: Method  Name: render" in text and "Parent" not in text
    assert Engine(blocks).render(Request("zzz")) == "No matching block."
    assert two_decimals(2.675) == "2.67"


def test_request():
    assert Request("q").context_lines is None and Request("q", context="+3").context_lines == 3
    assert Request("q", context="-1").context_lines is None and Request("q", context="abc").context_lines is None
    assert Request("q", lang="java, xml").languages == ["java", "xml"]
    with pytest.raises(ValueError):
        Request("q", limit=-1)


def test_empty_tables(spark, blocks):
    none = blocks.where("false")
    assert Engine(none).search(Request("user")).count() == 0
    assert R.vector_scores(none, spark.createDataFrame([], VECTOR), [1.0]).select(*KEY).count() == 0
    assert none.select(F.count("*")).first()[0] == 0


def test_many_requests_equal_single_ones(blocks):
    asked = [Request("user"), Request("find id", limit=1), Request("  "), Request("user", lang="java"), Request("user", path="p/b")]
    many = Engine(blocks).search_many(asked).collect()
    for i, r in enumerate(asked):
        want = [(x["name"], x["start_line"], round(x["score"], 9)) for x in Engine(blocks).search(r).collect()]
        got = sorted((x for x in many if x["request"] == i), key=lambda x: x["ordinal"])
        assert [(x["name"], x["start_line"], round(x["score"], 9)) for x in got] == want
    assert Engine(blocks).search_many([]).count() == 0

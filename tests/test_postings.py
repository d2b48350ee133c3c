"""Searches through posting lists against searches over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from corvine.operators import postings as P
from corvine.operators import ranking as R
from corvine.schema import BLOCK, Request

WORDS = ["find", "findUser", "user", "Id", "x=y[0]", "ΑΣ", "ΑΣ.Β", "straße", "İstanbul", "a", "the", "then", "theme", '"q"', "bar#baz"]


def blocks_of(spark, seed=1, n=120):
    rng = random.Random(seed)
    text = lambda k: rng.choice([" ", "\n", ".", "(", " , "]).join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    rows = []
    for i in range(n):
        start = rng.randint(1, 40)
        name = rng.choice(WORDS)
        kind = rng.choice(["Class", "Method", "Import", "Other"])
        rows.append(
            (f"/p/{rng.choice('abc')}/f{i % 9}.x", start, start + rng.randint(0, 9), text(30), rng.choice(["java", "xml", "vue"]), kind, name)
            + (rng.choice([None, "Parent"]), rng.choice([None, "sig (the)"]), rng.choice([[], ["@the"]]), [])
        )
    rows += rows[:3]  # repeated rows
    return spark.createDataFrame(rows, BLOCK)


ASKED = [
    Request("find user"),
    Request("the the a", limit=40),
    Request("findUser", lang=" java , xml,java"),
    Request("ασ straße", path="/b/"),
    Request("er", lang="vue", path="f1", limit=2),
    Request("İstanbul x=y[0]", limit=0),
    Request("nothing holds this"),
    Request(" ., ", limit=5),
    Request("the", lang=""),
    Request("q", limit=100),
]


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("request", "ordinal").collect()]


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    out = P.Postings(spark, str(tmp_path_factory.mktemp("lists")))
    out.write(blocks_of(spark), buckets=5)
    return out


@pytest.mark.parametrize("listed", [P.LISTED, 0])
def test_equal_to_single_searches(spark, lists, listed, monkeypatch):
    monkeypatch.setattr(P, "LISTED", listed)  # 0: all joins are by shuffle
    blocks = blocks_of(spark)
    got = R.whole_rows(blocks, lists.search(P.request_table(spark, ASKED)), 200, ("request",))
    want = []
    for i, r in enumerate(ASKED):
        found = R.bm25_search(R.keep_path(blocks, r.path), r.query, r.languages, r.limit).collect()
        want += [(i, k + 1, x["file_path"], x["start_line"], x["name"], x["content"], x["score"]) for k, x in enumerate(found)]
    own = ("request", "ordinal", "file_path", "start_line", "name", "content", "score")
    assert rows_of(got, *own) == want and len(want) > 60


def test_only_the_lists_of_the_terms_are_read(spark, lists):
    plan = lists.scores(P.request_table(spark, [Request("find user")]))._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [find,user])" in plan and "PartitionFilters: [bucket" in plan and "Python" not in plan


def test_sums_of_requests_are_made_where_the_block_is(spark, lists):
    """Postings are dealt by their block; a row for each request and term crosses no shuffle."""
    plan = lists.scores(P.request_table(spark, [Request("find user")]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__block" in plan and "hashpartitioning(request" not in plan


def test_a_new_write_replaces_the_lists(spark, tmp_path):
    lists = P.Postings(spark, str(tmp_path))
    lists.write(blocks_of(spark, 1), buckets=7)
    lists.write(blocks_of(spark, 2, 30), buckets=2)
    fresh = P.Postings(spark, str(tmp_path / "other"))
    fresh.write(blocks_of(spark, 2, 30), buckets=3)
    asked = P.request_table(spark, ASKED)
    own = ("request", "ordinal", "file_path", "start_line", "name", "score")
    assert rows_of(lists.search(asked), *own) == rows_of(fresh.search(asked), *own)


def test_no_blocks(spark, tmp_path):
    lists = P.Postings(spark, str(tmp_path))
    lists.write(blocks_of(spark).limit(0))
    assert lists.search(P.request_table(spark, ASKED)).count() == 0


def test_term_counts(spark):
    row = spark.createDataFrame([(["b", "a", "b"], ["b", "c"]), ([], [])], "t array<string>, h array<string>")
    got = [sorted(map(tuple, r[0])) for r in row.select(P.term_counts(F.col("t"), F.col("h"))).collect()]
    assert got == [[("a", 1, False), ("b", 2, True), ("c", 0, True)], []]


def test_term_counts_of_odd_words(spark):
    """Words that start with or follow others in any order, marks of all kinds, and long runs of one word."""
    words = ["the", "the\x01", "the\x00", "thé", "th", "t", "\\1", "$", "\U0001f600", "\U0001f600a", "\x1c"]
    rng = random.Random(3)
    rows = [([rng.choice(words) for _ in range(k)], rng.sample(words, k % 11)) for k in range(40)]
    rows += [(["same"] * 100_000, ["same"]), (["same"] * 100_000, []), ([], ["same"])]
    df = spark.createDataFrame(rows, "t array<string>, h array<string>").coalesce(1)
    got = [sorted(map(tuple, r[0])) for r in df.select(P.term_counts(F.col("t"), F.col("h"))).collect()]
    assert got == [sorted((w, t.count(w), w in h) for w in {*t, *h}) for t, h in rows]


def test_postings_are_made_without_lambdas_over_sorted_words(spark):
    """They took most of the time of an index: comparisons and runs of every word by expressions of lambdas."""
    plan = P.postings(blocks_of(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan and "zip_with" not in plan and "filter(" not in plan


def test_many_requests_in_one_pass(spark, lists):
    asked = [Request(f"{WORDS[i % 15]} {WORDS[i * 7 % 13]}", lang=[None, "java"][i % 2]) for i in range(10_000)]
    found = lists.search(P.request_table(spark, asked))
    got = {}
    for r in found.select("request", "ordinal", "name", "score").collect():
        got.setdefault(r["request"], []).append((r["ordinal"], r["name"], r["score"]))
    few = {}
    for r in lists.search(P.request_table(spark, asked[:26])).select("request", "ordinal", "name", "score").collect():
        few.setdefault(r["request"], []).append((r["ordinal"], r["name"], r["score"]))
    assert set(few) == {i for i in got if i < 26}
    for i, rows in got.items():  # the queries repeat
        same = next(j for j in range(i + 1) if asked[j] == asked[i])
        assert sorted(rows) == sorted(got[same])


def test_lists_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """A posting is its term and two numbers, and stays with the task that read its block."""
    put = {}
    own = P.Postings._put
    monkeypatch.setattr(P.Postings, "_put", lambda self, name, rows, *by: put.update({name: rows}) or own(self, name, rows, *by))
    P.Postings(spark, str(tmp_path)).write(blocks_of(spark), buckets=3)
    plans = {name: put[name]._jdf.queryExecution().executedPlan().toString() for name in ("blocks", "postings")}
    assert all("Exchange" not in p for p in plans.values())
    assert put["postings"].columns == ["term", "__row", "tf", "held", "bucket"]


def test_written_lists_are_the_postings_of_the_blocks(spark, lists):
    kept = lists.rows.drop("bucket").join(lists.blocks.select(*P.BLOCK), "__row")
    own = [*P.BLOCK[1:], "term", "tf", "held"]
    rows = lambda df: sorted(map(repr, df.select(*own).collect()))
    assert rows(kept) == rows(P.postings(blocks_of(spark)))


@pytest.mark.parametrize("tried", [P.TRIED, 0])
def test_words_of(spark, lists, tried, monkeypatch):
    monkeypatch.setattr(P, "TRIED", tried)  # 0: terms are looked up among the pieces of words
    words = {r[0] for r in lists.rows.where("held").select("term").collect()}
    terms = ["e", "a", "er", "the", "finduser", "x=y[0]", "ß", "nowhere", "themes"]
    found = lists.words_of(spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted(map(tuple, found)) == sorted((t, w) for t in terms for w in words if t in w)


def test_frequencies_of_frequent_terms_move_no_postings(spark, lists, monkeypatch):
    """Words that hold such a term are most words; a join with them by shuffle would deal all postings."""
    monkeypatch.setattr(P, "LISTED", 3)
    wanted = spark.createDataFrame([("f", "e", None, None), ("g", "the", ["java"], "/p/a")], "filter string, term string, languages array<string>, path string")
    df = lists.document_frequencies(wanted)
    got = sorted(map(tuple, df.collect()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(word" not in plan
    monkeypatch.setattr(P, "LISTED", 5_000)
    assert sorted(map(tuple, lists.document_frequencies(wanted).collect())) == got and [r[:2] for r in got] == [("f", "e"), ("g", "the")]

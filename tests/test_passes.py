"""Searches for many requests, in passes over whole blocks, against those by lists."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_postings import ASKED, WORDS, blocks_of

from corvine.operators import passes
from corvine.operators import postings as P
from corvine.schema import BLOCK, Request


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    odd = [("/p/a/f1.x", 100, 100, "the find", "x", "Other", "", None, None, [], []), ("/p/a/f1.x", 101, 101, "ΑΣ.Β " * 3, "java", "Class", "the", None, None, [], [])]
    out = P.Postings(spark, str(tmp_path_factory.mktemp("lists")))
    none = {c: F.when(F.col("kind") != "Other", F.col(c)) for c in ("language", "name")}
    out.write(blocks_of(spark).unionByName(spark.createDataFrame(odd, BLOCK).withColumns(none)), buckets=5)
    return out


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


FOUND = ("request", "ordinal", "file_path", "start_line", "end_line", "kind", "name", "__mark", "score")


@pytest.mark.parametrize("settings", [{}, {"WEIGHED": 4}, {"MEETING": 0}])
@pytest.mark.parametrize("overlap", ["outer", "inner"])
def test_equal_to_searches_by_lists(spark, lists, settings, overlap, monkeypatch):
    """In one pass and in several, with and without leaving out what cannot be listed; scores are equal bit for bit."""
    asked = P.request_table(spark, ASKED)
    want = rows_of(lists.search(asked, overlap), *FOUND)
    for name, value in ({"NAMED": 0} | settings).items():
        monkeypatch.setattr(P, name, value)
    assert rows_of(lists.search(asked, overlap), *FOUND) == want and len(want) > 60


def test_all_scores_are_given(spark, lists, monkeypatch):
    asked = P.request_table(spark, ASKED)
    own = ("request", "limit", *P.BLOCK, "score")
    want = rows_of(lists.scores(asked), *own)
    monkeypatch.setattr(P, "NAMED", 0)
    got = lists.scores(asked)
    assert rows_of(got, *own) == want and got.columns == list(own)


def documents(spark, n):
    rng = random.Random(5)
    rows = [(f"/s{i % 2}", i, i, " ".join(rng.choice(WORDS) for _ in range(12)), "en", "Other", f"doc_{i}", None, None, [], []) for i in range(n)]
    return spark.createDataFrame(rows, BLOCK)


def test_what_many_requests_ask_for_is_not_shuffled(spark, tmp_path):
    """Most blocks hold a term of every request: those that can be results leave a task, and no posting is read."""
    lists = P.Postings(spark, str(tmp_path))
    lists.write(documents(spark, 2_000).repartition(4))
    asked = P.request_table(spark, [Request(f"{WORDS[i % 15]} the a then {WORDS[i % 7]}", limit=4) for i in range(300)])
    found = lists._candidates(asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "postings" not in plan
    tasks = lists.blocks.select(F.spark_partition_id()).distinct().count()
    assert 300 * 4 <= found.count() <= 300 * 4 * tasks
    few = P.request_table(spark, [Request(f"{WORDS[i % 15]} the a then {WORDS[i % 7]}", limit=4) for i in range(20)])
    assert rows_of(lists.search(asked).where("request < 20"), *FOUND) == rows_of(lists.search(few), *FOUND)


def test_terms_in_words():
    rng = random.Random(1)
    word = lambda least, most: "".join(rng.choice("abñ") for _ in range(rng.randint(least, most))).encode()
    terms = list({word(1, 14) for _ in range(400)})
    terms += [t for t in (b"aaaaaaaa", b"aaaaaaaab", b"\xc3\xb1" * 9) if t not in terms]
    words = [b"", b"aaaaaaaab", b"\xc3\xb1" * 20, *[word(0, 40) for _ in range(500)]]
    sizes, numbers = passes._Terms(terms).of(pa.array([b"left out", *words], pa.binary()).slice(1))
    own = np.split(numbers, np.cumsum(sizes)[:-1])
    assert [set(x.tolist()) for x in own] == [{i for i, t in enumerate(terms) if t in w} for w in words]
    assert [x.tolist() for x in passes._Terms([]).of(pa.array(words, pa.binary()))] == [[0] * len(words), []]


def test_texts_that_few_tasks_read_are_dealt_anew(spark, tmp_path):
    text = "the find " * 50_000
    rows = [(f"/{i}", 1, 1, text, "en", "Other", "x", None, None, [], []) for i in range(40)]
    one = spark.createDataFrame(rows, BLOCK).coalesce(1)
    lists = P.Postings(spark, str(tmp_path))
    lists.write(one)
    assert lists.blocks.select(F.input_file_name()).distinct().count() >= 4 and lists.blocks.count() == 40
    assert P._spread(one, [1 << 20]) is one and P._spread(one, [3 << 20] * 8) is one

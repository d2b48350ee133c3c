"""Vectors for many requests: equal to one request at a time."""

import random

import numpy as np
import pytest

from corvine.operators import nearest as N
from corvine.operators import ranking as R
from corvine.plans.engine import Engine
from corvine.schema import BLOCK, VECTOR, Request

KEY = ["file_path", "start_line", "end_line"]
WORDS = ["find", "user", "load", "save", "x"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    blocks, vectors = [], []
    for i in range(400):
        key = (f"/p/{rng.choice('ab')}/f{i % 60}.java", 10 * i, 10 * i + rng.choice([5, 15]))
        blocks.append((*key, " ".join(rng.choice(WORDS) for _ in range(8)), "java", "Method", rng.choice(WORDS), None, None, [], []))
        vectors.append((*key, [rng.choice([0.0, 0.5, -0.5, 0.1]) for _ in range(8)]))  # many ties
    vectors += [("/p/a/gone.java", 1, 2, [9.0] * 8), ("/p/a/f0.java", 0, 1, [1.0])]  # without a block
    # in several tasks; a short vector, and one of zeros
    vectors[3] = (*vectors[3][:3], [0.5, 0.5])
    vectors[4] = (*vectors[4][:3], [0.0] * 8)
    return spark.createDataFrame(blocks, BLOCK).repartition(3).cache(), spark.createDataFrame(vectors, VECTOR).repartition(5).cache()


@pytest.mark.parametrize("products", [1 << 22, 50])
def test_equal_to_single_requests(tables, products, monkeypatch):
    monkeypatch.setattr(N, "PRODUCTS", products)
    blocks, vectors = tables
    rng = np.random.default_rng(2)
    asked = [N.Asked(i, rng.normal(size=8).tolist(), [None, "/p/a", "f1", "none"][i % 4], [1, 7, 90, 1000][i % 3]) for i in range(8)]
    asked += [N.Asked(20, [0.5, 0.5] + [0.0] * 6, None, 30), N.Asked(21, [1.0, 1.0], "/b/", 12), N.Asked(22, [0.0] * 8, None, 0)]
    got = {}
    for r in N.nearest(blocks, vectors, asked).collect():
        got.setdefault(r["request"], set()).add((*[r[c] for c in KEY], r["cosine"]))
    for a in asked:
        single = R.vector_top(R.vector_scores(R.keep_path(blocks, a.path), vectors, a.vector), a.k).collect()
        assert got.get(a.request, set()) == {(*[r[c] for c in KEY], r["cosine"]) for r in single}


def test_no_requests_and_no_vectors(spark, tables):
    blocks, vectors = tables
    assert N.nearest(blocks, vectors, []).count() == 0
    assert N.nearest(blocks, vectors.limit(0), [N.Asked(0, [1.0], None, 5)]).count() == 0


def embed(text):
    if "save" in text:
        raise RuntimeError("no model for this")
    return [len(w) / 7 for w in (text.split() * 8)[:8]]


def test_hybrid_searches(tables):
    """A request whose text has no vector, or no words, among others."""
    blocks, vectors = tables
    engine = Engine(blocks, vectors, embed)
    asked = [Request("find user"), Request("load", path="/p/a", limit=4), Request("save it", limit=3), Request("none of these"), Request("x", lang="xml"), Request("user", limit=0)]
    columns = [c for c in engine.search_many(asked).columns if c not in ("request", "ordinal", "tokens")]
    got = {}
    for r in sorted(engine.search_many(asked).collect(), key=lambda r: (r["request"], r["ordinal"])):
        got.setdefault(r["request"], []).append(tuple(map(repr, (r[c] for c in columns))))
    for i, r in enumerate(asked):
        assert got.get(i, []) == [tuple(map(repr, (x[c] for c in columns))) for x in engine.search(r).collect()]
    assert len(got[0]) == 10 and len(got[2]) == 3 and len(got[3]) == 10
    one = Engine(blocks, vectors, lambda text: 1 / 0)  # no text has one
    assert one.search_many(asked[:1]).orderBy("ordinal").select(*columns).collect() == one.search(asked[0]).select(*columns).collect()

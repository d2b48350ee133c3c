"""The pipeline against its operators' contracts, stage by stage, and the queries against DuckDB."""

import hashlib
import random

import pytest
from oracle import compare

import corpus_pipeline as P
from corvine.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, data, name):
    compare(queries.QUERIES[name](spark, data), queries.ORACLE[name], data)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_one_row_a_document(spark, data, name):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert queries.QUERIES[name](spark, data).count() == n


def jaccard(a, b):
    w = [t.translate({c: c + 32 for c in range(65, 91)}).split() for t in (a, b)]
    s = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} if len(x) > 4 else {tuple(x)} for x in w]
    return len(s[0] & s[1]) / max(len(s[0] | s[1]), 1)


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, data)
        if name != "tokenise":
            assert sorted(out.columns) == sorted(P.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r.asDict() for r in docs.collect()]
    first = seen["language_id"]
    assert len(first) == 200  # all of these have letters, so none is rejected
    best = {}
    for r in first:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(best.values())
    unique, parent = seen["exact_dedup"], {}
    for i, a in enumerate(unique):
        for b in unique[:i]:
            if jaccard(a["text"], b["text"]) >= 0.8:
                parent.setdefault(max(a["doc_id"], b["doc_id"]), set()).add(min(a["doc_id"], b["doc_id"]))
    # a document goes exactly if some smaller one is reachable; with links upwards only to smaller ids that is
    # having a smaller neighbour, or a neighbour that has one
    links = {(a, b) for a, bs in parent.items() for b in bs}
    reach = {r["doc_id"]: r["doc_id"] for r in unique}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(reach[a], reach[b])
            changed |= reach[a] != m or reach[b] != m
            reach[a] = reach[b] = m
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == sorted(k for k, v in reach.items() if k == v)
    mixed = seen["mixing"]
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in seen["near_dedup"]}
    count = lambda rows: sum(len(r["text"].split()) for r in rows)
    # leaves are small here, and what does not fit a leaf's rest is not taken
    assert 0.5 * count(seen["near_dedup"]) < count(mixed) <= P.MIX_SHARE * count(seen["near_dedup"])
    last = seen["tokenise"]
    assert len(last) == len(mixed) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)
    run = [r.asDict() for r in P.run(spark, data).collect()]
    digest = lambda rows: sorted((r["doc_id"], hashlib.md5(str(r["ids"]).encode()).hexdigest()) for r in rows)
    assert digest(run) == digest(last)


def test_odd_documents(spark, documents, odd, tmp_path):
    docs = documents(odd).select(*P.COLUMNS)
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, "")
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.where("NOT round_trip").count() == 0


def test_empty_documents(spark, documents):
    docs = documents([]).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_language_stage_corrects_and_keeps(spark, documents):
    rng = random.Random(3)
    prose = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows = [(i, prose("aeiomnrst" if i % 2 else "uyjkwxzqv"), "en" if i % 2 else "fi", "src1") for i in range(1200)]
    wrong = [(2001, prose("aeiomnrst"), "fi", "src1"), (2002, prose("uyjkwxzqv"), "en", "src1"), (2003, prose("aeiomnrst"), None, "src1")]
    found = {r["doc_id"]: r["lang"] for r in P.identify_language(spark, documents([*rows, *wrong]), "").collect()}
    assert [found[k] for k in (2001, 2002, 2003)] == ["en", "fi", "en"]
    assert all(found[i] == lang for i, _, lang, _ in rows)
    bare = [(i, t, None, s) for i, t, _, s in rows[:20]] + [(50, "12 34", None, None), (51, None, None, None), (52, "", None, None)]
    kept = P.identify_language(spark, documents(bare), "")
    assert kept.columns == P.COLUMNS
    assert sorted((r["doc_id"], r["lang"]) for r in kept.collect()) == [(i, None) for i in range(20)]

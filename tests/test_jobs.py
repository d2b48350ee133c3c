"""The jobs: over the tables against DuckDB, and over growing and odd input against direct counts."""

import json
import re
from collections import Counter

import pytest
from oracle import compare
from pyspark.sql import functions as F

from jobs import answer_requests as A
from jobs import common
from jobs import index_documents as I
from jobs import queries

DOCS = "doc_id bigint, text string, lang string, source string, digest string, batch string"
CONFIG = common.defaults("index_documents")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, data, name):
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    compare(queries.QUERIES[name](spark, data), queries.ORACLE[name], data)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "b") for r in rows], DOCS)


def split(text):
    return [w for w in re.split(r"[\s.,;(){}<>:/\\]+", text or "") if w]


def want(rows):
    """rows: the newest version of each document."""
    out = []
    for i, text, lang, source in rows:
        tf = Counter(w.lower() for w in split(text))
        held = set(split((text or "").lower()))
        out += [(i, lang, source, sum(tf.values()), w, tf[w], w in held) for w in tf.keys() | held]
    return sorted(out, key=repr)


def got(spark, out):
    rows = I.current_postings(spark, out).select("doc_id", "lang", "source", "n_tokens", "term", "tf", "held").collect()
    return sorted(map(tuple, rows), key=repr)


def totals(rows):
    out = {}
    for _, text, lang, source in rows:
        n, tokens = out.get((lang, source), (0, 0))
        out[lang, source] = (n + 1, tokens + len(split(text)))
    return out


FIRST = [(1, "One two. Two", "en", "a"), (2, "", "en", "a"), (3, None, None, None), (4, "ΑΣ.Β x", "el", "b"), (5, "same", "en", "b"), (None, "no id", "en", "a")]
SECOND = [(1, "one THREE", "en", "a"), (5, "same", "en", "b"), (6, "new new", "fr", None), (4, "ΑΣ.Β x", "el", "c")]
THIRD = [(1, "One two. Two", "en", "a"), (7, "x", "en", "a"), (7, "x", "en", "a"), (7, "w", "en", "a"), (3, None, None, None)]


def current(*parts):
    """Later parts win; within one, the greatest digest, lang and source."""
    import hashlib

    out = {}
    for part in parts:
        own = {}
        for r in part:
            if r[0] is not None:
                key = (hashlib.sha256((r[1] or "").encode()).hexdigest(), r[2] or "", r[3] or "")
                own[r[0]] = max(own.get(r[0], (("", "", ""), None)), (key, r), key=lambda x: x[0])
        out |= {i: r for i, (_, r) in own.items()}
    return list(out.values())


def test_index_follows_growing_input(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: I.index_documents(spark, src, out, mark, CONFIG)
    done, reports = [], []
    for part in (FIRST, SECOND, THIRD):
        table(spark, part).coalesce(1).write.mode("append").parquet(src)
        done.append(part)
        reports += run()
        assert got(spark, out) == want(current(*done))
        sums = {(r["lang"], r["source"]): (r["n_documents"], r["n_tokens"]) for r in I.current_totals(spark, out).collect()}
        assert sums == totals(current(*done))
        assert run() == []  # only what is new is taken
    assert [(r["batch"], r["rows"], r["without_id"], r["versions"], r["replaced"]) for r in reports] == [(0, 6, 1, 5, 0), (1, 4, 0, 3, 2), (2, 5, 0, 2, 1)]


def test_a_batch_can_be_repeated(spark, tmp_path):
    """As after a failure between its writes: the same batch again, before and after a later one."""
    out = str(tmp_path)
    batches = [table(spark, part).drop("digest", "batch") for part in (FIRST, SECOND, THIRD)]
    for number in (0, 1, 1, 2, 2):
        I.index_batch(batches[number], number, out, 4)
    assert got(spark, out) == want(current(FIRST, SECOND, THIRD))
    before = sorted(map(repr, I.current_totals(spark, out).collect()))
    I.index_batch(batches[2], 2, out, 4)
    assert sorted(map(repr, I.current_totals(spark, out).collect())) == before


def test_files_over_several_batches(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    reports = I.index_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG | {"files_per_batch": 2})
    assert len(reports) == 3 and sum(r["versions"] for r in reports) == docs.count()
    assert got(spark, str(tmp_path / "out")) == want([tuple(r) for r in docs.collect()])


def test_no_documents(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "in"))
    I.index_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG)
    assert I.current_postings(spark, str(tmp_path / "out")).count() == I.current_totals(spark, str(tmp_path / "out")).count() == 0


def test_odd_requests(spark, tmp_path):
    docs, asked, out = (str(tmp_path / x) for x in ("docs", "asked", "out"))
    many = [(i, f"common word{i} tail", "en", f"s{i % 2}") for i in range(2**31, 2**31 + 9)]
    table(spark, [*FIRST, *many]).write.parquet(docs)
    rows = [(1, "common", None), (2, None, None), (None, "common", None), (3, "word2147483650", 1), (4, "common", 1), (4, "a", 5), (5, "Two One", 5)]
    spark.createDataFrame(rows, "item_id bigint, text string, limit int").write.parquet(asked)
    run = lambda: A.answer_requests(spark, docs, asked, out, common.defaults("answer_requests"))
    counts = run()
    assert (counts["documents"], counts["documents_without_id"], counts["requests"], counts["requests_without_id"]) == (15, 1, 7, 1)
    first = sorted(map(tuple, A.results(spark, out).collect()))
    by = {}
    for item, ordinal, doc, *_ in first:
        by.setdefault(item, []).append((ordinal, doc))
    b = 2**31
    assert by == {1: [(1, b), (2, b + 2), (3, b + 4), (4, b + 1), (5, b + 3), (6, b + 5)], 3: [(1, b + 2)], 4: [(1, b)], 5: [(1, 1)]}
    assert run() == counts and sorted(map(tuple, A.results(spark, out).collect())) == first


def test_command_lines(spark, tmp_path, data, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)  # the session is the tests'
    (tmp_path / "c.json").write_text(json.dumps({"files_per_batch": 1}))
    (tmp_path / "bad.json").write_text(json.dumps({"files": 1}))
    own = ["--documents", f"{data}/documents.parquet*", "--output", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/m", "--config"]
    assert I.main([*own, f"{tmp_path}/c.json"]) == 0
    assert I.current_totals(spark, f"{tmp_path}/o").agg(F.sum("n_documents")).first()[0] == 200
    with pytest.raises(ValueError, match="unknown settings: files"):
        I.main([*own, f"{tmp_path}/bad.json"])
    assert A.main(["--documents", f"{data}/documents.parquet", "--requests", f"{data}/benchmark.parquet", "--output", f"{tmp_path}/r"]) == 0
    assert A.results(spark, f"{tmp_path}/r").count() > 0

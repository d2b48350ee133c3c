"""Every catalogue query with SQL agrees with DuckDB; the others give rows."""

import pytest
from oracle import compare

from corvine.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, data, name):
    compare(catalogue.QUERIES[name](spark, data), catalogue.ORACLE[name], data)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_rows(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10


def test_plan_reads_only_what_it_needs(spark, data):
    plan = catalogue.latest_per_key(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
    path = catalogue.bm25_path(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(source,src1)" in path
    assert "Python" not in path


def test_upsert_keeps_and_puts(spark, data):
    from corvine.streaming.updater import newest

    before, after = catalogue.before_and_after(catalogue.changes(spark, data))
    assert before.agg({"ts": "max"}).first()[0] < after.agg({"ts": "min"}).first()[0]
    held = {r["path"] for r in catalogue.updated_index(spark, catalogue.changes(spark, data)).files().collect()}
    old, new = ({r["path"]: r["op"] for r in newest(x).collect()} for x in (before, after))
    kept = {p for p, op in old.items() if op == "upsert" and p not in new}
    put = {p for p, op in new.items() if op == "upsert"}
    assert kept and put and held == kept | put


def test_halves_of_a_log_are_cut_once(spark, data, monkeypatch):
    """However approximate the time is, every change is in one half: here any of the paths' times is found."""
    from pyspark.sql import functions as F

    now = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime"))
    any_of = lambda c, _: F.get(F.sort_array(F.collect_list(c)), F.pmod(F.hash(now), F.count(c)).cast("int"))
    monkeypatch.setattr(F, "percentile_approx", any_of)
    log = catalogue.changes(spark, data)
    before, after = catalogue.before_and_after(log)
    ids = [r["seq"] for half in (before, after) for _ in range(2) for r in half.select("seq").collect()]
    assert sorted(ids) == sorted([r["seq"] for r in log.select("seq").collect()] * 2)


def test_antijoin_drops_what_spanning_blocks_contain(spark, data):
    own = ["file_path", "start_line", "end_line", "name"]
    blocks = catalogue.conversation_blocks(spark, data)
    rows = lambda df: sorted(map(tuple, df.select(*own).collect()))
    kept = rows(catalogue.not_contained(blocks))
    assert kept == rows(catalogue.overlap_outermost(spark, data))
    assert 0 < len(kept) < blocks.count() and {r[3] for r in kept} == {"whole"}
    plan = catalogue.overlap_antijoin(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Window" not in plan

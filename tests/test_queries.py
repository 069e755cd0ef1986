"""Every registered query of the engine against its SQL, at the smallest size."""

import os

import duckdb
import pytest

from foliant import api
from foliant.operators import regions
from foliant.plans import queries
from foliant.plans.queries import ORACLE_SQL, QUERIES
from foliant.shared import cut

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(rows):
    return sorted(tuple((k, None if v != v else v) for k, v in sorted(r.items())) for r in rows) if rows else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    want = duck.sql(ORACLE_SQL[name]).to_arrow_table().to_pylist()
    key = lambda r: repr(plain([r]))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_paragraphs_are_read_where_they_lie(spark):
    """The links' paragraphs are not dealt and written once more before the joins, which do so themselves."""
    paras, made = queries._regions(spark, DATA, 3)
    assert all("documents.parquet" in f for f in [*paras.inputFiles(), *made.inputFiles()])


def test_regions_of_candidates_count(spark, monkeypatch):
    """What postprocess_candidates gives the plan has regions of all kinds, and drawings change what they take out of texts."""
    given = {}

    def taken(candidates, lines, pages, tables=None, graphics=None, images=None):
        given.update(lines=lines, pages=pages, tables=tables, graphics=graphics)
        raise InterruptedError

    monkeypatch.setattr(api, "postprocess_candidates", taken)
    with pytest.raises(InterruptedError):
        QUERIES["postprocess_candidates"](spark, DATA)

    def planned():
        plan = cut(regions.plan(**given), "planned")
        kinds = {(r["kind"], r["cap_text"] is not None) for r in plan.select("kind", "cap_text").collect()}
        return kinds, {tuple(r) for r in regions.region_chars(given["lines"], plan).collect()}

    kinds, chars = planned()
    assert kinds == {("table", False), ("figure", True), ("equation", False)}
    made = regions.ink_box
    monkeypatch.setattr(regions, "ink_box", lambda *a: made(*a).limit(0))
    assert planned()[1] != chars


def test_candidates_are_not_broadcast(spark):
    """All that postprocess_candidates joins grows with the documents, so none of it is sent whole through the driver, though
    here all of it is small enough."""

    def ran():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in map(found.apply, range(found.size()))}

    last = max(ran(), default=-1)
    QUERIES["postprocess_candidates"](spark, DATA).write.format("noop").mode("overwrite").save()
    plans = [plan for n, plan in ran().items() if n > last]
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]

"""As-of joins and chains of links against plain Python."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dockyard.operators import links
from dockyard.operators.asof import asof_join
from dockyard.operators.links import walk

KEYS = st.sampled_from(["a", "b", "hot", "hot", None])
PLACES = st.one_of(st.none(), st.integers(0, 20))


def plain(lefts, rights, forward):
    out = []
    for key, at, n in lefts:
        found = [r for r in rights if None not in (key, at, r[0], r[1]) and r[0] == key and (r[1] >= at if forward else r[1] <= at)]
        best = (min if forward else max)(found, key=lambda r: (r[1], r[2]), default=(None, None, None))
        out.append((key, at, n, best[2]))
    return sorted(out, key=lambda r: r[2])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(KEYS, PLACES), max_size=60), st.lists(st.tuples(KEYS, PLACES), max_size=40), st.booleans())
def test_asof_join_equals_a_loop(spark, lefts, rights, forward):
    lefts = [(k, p, n) for n, (k, p) in enumerate(lefts)]
    rights = [(k, p, n) for n, (k, p) in enumerate(rights)]
    left = spark.createDataFrame(lefts, "id string, at long, n long")
    right = spark.createDataFrame(rights, "id string, since long, v long")
    found = asof_join(left, right, "id", "at", "since", ["v"], order="v", forward=forward)
    assert found.columns == ["id", "at", "n", "v"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[2]) == plain(lefts, rights, forward)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_join_carries_over_many_ranges(spark, forward):
    """One right row serves a key that fills all ranges; small Arrow batches inside each of them."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(1, 3000).selectExpr("'hot' AS id", "id AS at", "id % 3 AS n")
        right = spark.createDataFrame([("hot", 3000 if forward else 0, 1), ("cold", 5, 2), ("zz", 7, 3)], "id string, since long, v long")
        found = asof_join(left, right, "id", "at", "since", ["v"], forward=forward)
        assert [tuple(r) for r in found.groupBy("v").count().collect()] == [(1, 2999)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_join_of_nothing(spark):
    left = spark.createDataFrame([("a", 1)], "id string, at long")
    right = spark.createDataFrame([], "id string, since long, v string")
    assert [tuple(r) for r in asof_join(left, right, "id", "at", "since", ["v"]).collect()] == [("a", 1, None)]
    assert asof_join(left.where("false"), right, "id", "at", "since", ["v"]).count() == 0


@pytest.mark.parametrize("crowd", [0, 100_000])
def test_a_walk_finds_each_step_of_a_chain(spark, monkeypatch, crowd):
    """A chain of 37 nodes, and many others that lead into its end; the crowd at one target is joined apart."""
    monkeypatch.setattr(links, "CROWD", crowd)
    rows = [(n, n + 1) for n in range(37)] + [(100 + n, 20) for n in range(200)] + [(37, None)]
    table = spark.createDataFrame(rows, "node long, next long")
    found = walk(spark.createDataFrame([(0, "x")], "node long, name string"), table, 300)
    assert sorted(map(tuple, found.collect())) == [(n, n, "x") for n in range(38)]
    assert walk(spark.createDataFrame([(5,)], "node long"), table, 3).count() == 4
    assert [tuple(r) for r in walk(spark.createDataFrame([(5,)], "node long"), table, 0).collect()] == [(5, 0)]


def test_a_cycle_is_walked_to_the_bound(spark):
    table = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, next long")
    found = [tuple(r) for r in walk(spark.createDataFrame([(1,)], "node long"), table, 6).collect()]
    assert sorted(found, key=lambda r: r[1]) == [(1, 0), (2, 1), (3, 2), (1, 3), (2, 4), (3, 5), (1, 6)]

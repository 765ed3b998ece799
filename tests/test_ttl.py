"""Anchored time to live against a plain loop, on every path."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dockyard.operators import links
from dockyard.operators import ttl as ttl_module
from dockyard.operators.cache import checked_expiry, current_entries, evict, get_or_compute, missing_keys, stored_expiry
from dockyard.operators.ttl import accepted_arrivals, classify_arrivals, drop_repeats, ledger_entries
from dockyard.plans.queries import QUERIES

START = datetime(2024, 1, 1)
SCHEMA = "id string, received_at timestamp_ntz, seq long"


def loop(rows, ttl, ledger=None):
    """Accepted sequence numbers, one row at a time."""
    open_at, accepted = dict(ledger or {}), set()
    for key, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        if not key or key not in open_at or ts >= open_at[key]:
            accepted.add(seq)
            open_at[key] = ts + ttl
    return accepted


def run(spark, rows, **options):
    df = classify_arrivals(spark.createDataFrame(rows, SCHEMA), **options)
    got = df.collect()
    assert len(got) == len(rows)
    return {r["seq"] for r in got if r["accepted"]}


def at(hours):
    return START + timedelta(hours=hours)


def test_anchor_is_not_renewed(spark):
    hours = [0, 24 - 1 / 3600, 24, 36, 84]
    rows = [("a", at(h), i) for i, h in enumerate(hours)]
    assert run(spark, rows) == {0, 2, 4}


def test_blank_ids_are_never_duplicates(spark):
    rows = [("", at(0), 1), ("", at(0), 2), (None, at(0), 3), (None, at(1), 4), ("a", at(0), 5), ("a", at(1), 6)]
    assert run(spark, rows) == {1, 2, 3, 4, 5}


def test_numeric_zero_is_no_id(spark):
    rows = spark.createDataFrame([(0, at(0), 1), (0, at(1), 2), (7, at(0), 3), (7, at(1), 4)], SCHEMA.replace("id string", "id long"))
    assert {r["seq"] for r in accepted_arrivals(rows).collect()} == {1, 2, 3}


def test_no_rows(spark):
    assert run(spark, []) == set()


arrival = st.tuples(st.sampled_from(["a", "b", "c", "hot", "hot", "hot", ""]), st.integers(0, 400))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(arrival, max_size=120), st.sampled_from([1, 7, 24]), st.sampled_from([3, 20]), st.booleans())
def test_every_path_equals_the_loop(spark, drawn, ttl_hours, bound, with_ledger):
    rows = [(key, at(quarter / 4), i) for i, (key, quarter) in enumerate(drawn)]
    ttl = timedelta(hours=ttl_hours)
    ledger = {"a": at(3), "hot": at(5), "unused": at(9)} if with_ledger else None
    table = None
    if ledger:
        table = spark.createDataFrame([*ledger.items(), ("a", at(1))], "k string, expires_at timestamp_ntz")
    got = run(spark, rows, ttl=ttl, ledger=table, group_bound=bound)
    assert got == loop(rows, ttl, ledger)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(arrival, max_size=150), st.sampled_from([0.25, 1, 7, 24]), st.sampled_from([5, 17]), st.booleans())
def test_chunk_walks_equal_the_loop(spark, drawn, ttl_hours, size, with_ledger):
    """Every key is hot and cut into chunks; ties in time, gaps of many TTLs, and a ledger that opens in the midst of a chunk."""
    rows = [(key, at(quarter / 4), i) for i, (key, quarter) in enumerate(drawn)]
    ttl = timedelta(hours=ttl_hours)
    ledger = {"a": at(3), "hot": at(50)} if with_ledger else None
    table = spark.createDataFrame(list(ledger.items()), "k string, expires_at timestamp_ntz") if ledger else None
    before, ttl_module.CHUNK_ROWS = ttl_module.CHUNK_ROWS, size
    try:
        got = run(spark, rows, ttl=ttl, ledger=table, group_bound=0)
    finally:
        ttl_module.CHUNK_ROWS = before
    assert got == loop(rows, ttl, ledger)


@pytest.mark.parametrize("size", [100, 1_000_000])
def test_hot_id_is_split_and_equals_the_fold(spark, monkeypatch, size):
    """One id holds half of the rows; its walk passes many chunks, or one."""
    monkeypatch.setattr(ttl_module, "CHUNK_ROWS", size)
    n = 4000
    rows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("id"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=F.expr("pow(id, 1.7)"))).alias("received_at"),
        F.col("id").alias("seq"),
    )
    ttl = timedelta(hours=6)
    fold = accepted_arrivals(rows, ttl=ttl, group_bound=n).select("seq")
    walk = accepted_arrivals(rows, ttl=ttl, group_bound=100).select("seq")
    assert fold.exceptAll(walk).isEmpty() and walk.exceptAll(fold).isEmpty()
    plain = [(r["id"], r["received_at"], r["seq"]) for r in rows.collect()]
    assert {r["seq"] for r in walk.collect()} == loop(plain, ttl)


def test_rounds_grow_with_the_logarithm_of_the_chunks(spark, monkeypatch):
    """64 chunks of one id that a walk all passes: six tables of jumps, not 64 steps."""
    monkeypatch.setattr(ttl_module, "CHUNK_ROWS", 10)
    tables = []
    hop = links._hop
    monkeypatch.setattr(links, "_hop", lambda jumps, n: tables.append(n) or hop(jumps, n))
    rows = [("hot", START + timedelta(minutes=m), m) for m in range(640)]
    got = accepted_arrivals(spark.createDataFrame(rows, SCHEMA), ttl=timedelta(minutes=9), group_bound=5)
    assert {r["seq"] for r in got.collect()} == set(range(0, 640, 9))
    assert len(tables) <= 6


def test_never_expiring_ledger(spark):
    ledger = spark.createDataFrame([("a", None)], "k string, expires_at timestamp_ntz")
    assert run(spark, [("a", at(0), 1), ("b", at(0), 2)], ledger=ledger) == {2}


def test_drop_repeats_keeps_all_columns(spark):
    rows = [("a", at(0), 1, "x"), ("a", at(1), 2, "y"), ("b", at(1), 3, "z")]
    df = spark.createDataFrame(rows, SCHEMA + ", payload string")
    assert sorted(r["payload"] for r in drop_repeats(df).collect()) == ["x", "z"]


def test_ledger_entries(spark):
    rows = spark.createDataFrame([("a", at(0), 1), ("", at(0), 2), (None, at(0), 3)], SCHEMA)
    assert [tuple(r) for r in ledger_entries(rows).collect()] == [("a", at(0), at(24))]


ENTRIES = "k string, v string, written_at timestamp_ntz, seq long, expires_at timestamp_ntz"


@pytest.fixture
def entries(spark):
    return spark.createDataFrame([
        ("a", "old", at(0), 1, None), ("a", "new", at(1), 2, at(9)),   # last put counts
        ("b", "b", at(0), 3, at(5)),                                   # expires exactly now
        ("c", "c", at(0), 4, None),                                    # blank expiry
        ("d", None, at(0), 5, None),                                   # no value
        ("e", "later", at(7), 6, None),                                # not written yet
    ], ENTRIES)


def test_current_entries(spark, entries):
    now = F.lit(at(5)).cast("timestamp_ntz")
    assert {(r["k"], r["v"]) for r in current_entries(entries, now).collect()} == {("a", "new"), ("c", "c"), ("d", None)}


def test_get_or_compute(spark, entries):
    now = F.lit(at(5)).cast("timestamp_ntz")
    keys = spark.createDataFrame([(k,) for k in "aabcde"], "k string")
    assert {r["k"] for r in missing_keys(keys, entries, now).collect()} == {"b", "d", "e"}
    compute = lambda m: m.select("k", F.when(F.col("k") != "e", F.concat(F.lit("got "), "k")).alias("v"))
    values, computed = get_or_compute(keys, entries, compute, now)
    assert {tuple(r) for r in values.collect()} == {("a", "new"), ("c", "c"), ("b", "got b"), ("d", "got d")}
    assert {r["k"] for r in computed.collect()} == {"b", "d"}


@pytest.mark.parametrize("bound", [1, 20_000])
@pytest.mark.parametrize(("hours", "want"), [(12, [True, True]), (13, [True, False]), (24, [True, False])])
def test_a_ttl_is_elapsed_time_over_a_clock_change(spark, bound, hours, want):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 25 hours of that day: 04:00Z and 16:00Z are twelve hours apart on any clock.
        rows = spark.sql("SELECT 'a' AS id, timestamp_seconds(1730606400 + 43200 * id) AS received_at, id AS seq FROM range(2)")
        got = classify_arrivals(rows, ttl=timedelta(hours=hours), group_bound=bound).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["accepted"] for r in got] == want


def test_unreadable_expiry_is_refused_at_put_and_expired_at_get(spark):
    rows = spark.createDataFrame([("a", "soon"), ("b", "2025-06-01T00:00:00Z"), ("c", "")], "k string, text string")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    good, refused = checked_expiry(rows, F.col("text"), now)
    assert {r["k"]: str(r["expires_at"]) for r in good.collect()} == {"b": "2025-06-01 00:00:00", "c": "2024-01-03 00:00:00"}
    assert [tuple(r) for r in refused.collect()] == [("a", "soon")]
    stored = rows.select("k", F.lit(1).alias("v"), now.alias("written_at"), F.lit(1).alias("seq"), stored_expiry(F.col("text")).alias("expires_at"))
    for year, live in ((2024, "bc"), (2030, "c")):
        found = current_entries(stored, F.lit(f"{year}-01-02 00:00:00").cast("timestamp_ntz"))
        assert sorted(r["k"] for r in found.collect()) == list(live)


def test_eviction_changes_no_later_look(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [("a", 1, at(1), 1, None), ("a", 2, at(2), 2, at(3)), ("b", 3, at(1), 3, at(9)), ("b", 4, at(1), 4, at(9)), ("c", 5, at(6), 5, at(7))]
    entries = spark.createDataFrame(rows, "k string, v int, written_at timestamp_ntz, seq int, expires_at timestamp_ntz")
    left = evict(entries, F.lit(str(at(4))).cast("timestamp_ntz"))
    assert sorted(r["v"] for r in left.collect()) == [4, 5]
    for day in (4, 6, 8, 10):
        now = F.lit(str(at(day))).cast("timestamp_ntz")
        assert sorted(current_entries(left, now).collect()) == sorted(current_entries(entries, now).collect())


def test_hot_ids_take_few_jobs(spark):
    """The registered query over 10,000 arrivals of five ids, in six chunks."""
    spark.sparkContext.setJobGroup("hot", "hot ids")
    try:
        QUERIES["ttl_dedup_hot"](spark, "/root/testdata/sf0.01").collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("hot"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 45

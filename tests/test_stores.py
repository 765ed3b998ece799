"""Stored entries, the stored board, the bucketed ledger, dictionaries by position and by version."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dockyard.operators.asof import asof_join
from dockyard.operators.entries import EntryStore
from dockyard.operators.lookup import resolve_codes, resolve_codes_as_of
from dockyard.operators.outcomes import board_cells, read_board, status_board, upsert_board
from dockyard.streaming.intake import decide_batch
from dockyard.streaming.ledger import SLICES, Ledger

START = datetime(2024, 1, 1)
ENTRY = "k string, v long, written_at timestamp_ntz, seq long, expires_at string"


def at(hours):
    return START + timedelta(hours=hours)


def now(hours):
    return F.lit(str(at(hours))).cast("timestamp_ntz")


def looked(store, hours):
    return sorted((r["k"], r["v"]) for r in store.look(now(hours)).collect())


@pytest.fixture
def store(spark, tmp_path):
    return EntryStore(spark, str(tmp_path), ENTRY)


def rows(spark, *entries):
    return spark.createDataFrame([(k, v, at(h), n, e) for n, (k, v, h, e) in enumerate(entries)], ENTRY)


def test_looks_are_equal_before_and_after_compaction(spark, store):
    store.put(rows(spark, ("a", 1, 0, "2024-01-01T05:00:00"), ("b", 2, 0, ""), ("c", 3, 0, "soon"), ("d", 4, 9, "2024-01-02")))
    store.put(rows(spark, ("a", 5, 1, "2024-01-01T04:00:00"), ("e", 6, 1, None)))
    before = [looked(store, h) for h in (2, 5, 10, 40)]
    assert before[0] == [("a", 5), ("b", 2), ("e", 6)] and before[2][2:] == [("e", 6)] and ("d", 4) in before[2]
    assert store.compact(now(2)) == 1
    assert [looked(store, h) for h in (2, 5, 10, 40)] == before
    # Replaced and expired entries are gone from the table itself.
    assert store.entries().count() == 4
    store.put(rows(spark, ("a", 7, 3, "")))
    assert looked(store, 3)[0] == ("a", 7)
    assert store.compact(now(30)) == 2
    assert sorted(r["k"] for r in store.entries().collect()) == ["a", "b", "e"]


def test_a_reader_that_began_before_a_compaction_goes_on(spark, store):
    store.put(rows(spark, ("a", 1, 0, ""), ("b", 2, 0, "2024-01-01T01:00:00")))
    begun = store.look(now(0))
    store.compact(now(5))
    store.put(rows(spark, ("c", 3, 6, "")))
    assert sorted(r["k"] for r in begun.collect()) == ["a", "b"]
    store.vacuum()
    assert looked(store, 6) == [("a", 1), ("c", 3)]


def test_a_damaged_put_is_set_aside(spark, store, tmp_path):
    store.put(rows(spark, ("a", 1, 0, "")))
    bad = store.put(rows(spark, ("b", 2, 0, ""), ("c", 3, 0, "")))
    folder = tmp_path / "puts" / bad
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            (folder / name).write_bytes(b"half a file")
            crc = folder / f".{name}.crc"
            if crc.exists():
                crc.unlink()
    assert store.damaged() == [bad]
    assert looked(store, 1) == [("a", 1)]
    store.compact(now(1))
    assert [r["put"] for r in spark.read.parquet(f"{tmp_path}/aside").collect()] == [bad]
    assert store.damaged() == [] and looked(store, 1) == [("a", 1)]
    store.put(rows(spark, ("b", 9, 2, "")))
    assert looked(store, 2) == [("a", 1), ("b", 9)]


def test_an_empty_store_and_an_empty_put(spark, store):
    assert looked(store, 0) == []
    store.put(rows(spark, ("a", 1, 0, "")).where("false"))
    assert looked(store, 0) == [] and store.damaged() == []


UPDATES = "row_no long, field string, value long, at timestamp_ntz, seq long"


def test_a_board_of_batches_equals_the_whole(spark, tmp_path):
    plain = [(n % 7, ("progress", "runs", "duration", "other")[n % 4], None if n % 11 == 0 else n, at(n * 37 % 50), n) for n in range(120)]
    whole = spark.createDataFrame(plain, UPDATES)
    for part in (2, 0, 1, 0):
        upsert_board(spark, str(tmp_path), whole.where(F.col("seq") % 3 == part), parts=4)
    found = read_board(spark, str(tmp_path), board_cells(whole).schema)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, status_board(whole).collect()))


def test_only_touched_parts_of_a_board_are_written(spark, tmp_path):
    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "board") for f in names if f.endswith(".parquet")}

    upsert_board(spark, str(tmp_path), spark.createDataFrame([(n, "runs", n, at(0), n) for n in range(64)], UPDATES), parts=8)
    before = files()
    upsert_board(spark, str(tmp_path), spark.createDataFrame([(5, "runs", 99, at(1), 100)], UPDATES), parts=8)
    after = files()
    assert len(before.keys() - after.keys()) == 1 and len(before.keys() & after.keys()) == len(before) - 1
    upsert_board(spark, str(tmp_path), spark.createDataFrame([], UPDATES), parts=8)
    assert files() == after


def test_a_dictionary_follows_its_positions(spark):
    codes = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "c string")
    names = spark.createDataFrame([("1", "new", 9), ("1", "old", 2), ("2", None, 5), ("2", "x", 4)], "k string, v string, pos long")
    assert [r["c"] for r in resolve_codes(codes, names, ["c"], pos="pos").collect()] == ["new", None, "", ""]
    # Without positions nothing tells which of two names counts.
    with pytest.raises(Exception, match="no position tells"):
        resolve_codes(codes, names.drop("pos"), ["c"]).collect()
    same = spark.createDataFrame([("1", "a"), ("1", "a")], "k string, v string")
    assert [r["c"] for r in resolve_codes(codes, same, ["c"]).collect()] == ["a", "", "", ""]


def test_names_of_the_time(spark):
    rows = spark.createDataFrame([("1", at(0)), ("1", at(5)), ("1", at(9)), ("2", at(9)), ("1", None)], "c string, at timestamp_ntz")
    versions = spark.createDataFrame([(at(1), "1", "first"), (at(9), "1", "second"), (at(1), "2", "gone")], "valid_from timestamp_ntz, k string, v string")
    found = resolve_codes_as_of(rows, versions, ["c"], "at")
    assert sorted(((r["at"], r["c"]) for r in found.collect()), key=str) == sorted([(at(0), ""), (at(5), "first"), (at(9), "second"), (at(9), ""), (None, "")], key=str)


def test_versions_are_found_for_times_not_for_rows(spark, monkeypatch):
    seen = []

    def joined(left, *args, **options):
        seen.append((len(left.columns), left.count()))
        return asof_join(left, *args, **options)

    monkeypatch.setattr("dockyard.operators.lookup.asof_join", joined)
    rows = spark.createDataFrame([("1", at(n % 4 * 3), "wide " * 50) for n in range(40)] + [("1", None, "x")] * 2, "c string, at timestamp_ntz, text string")
    versions = spark.createDataFrame([(at(1), "1", "first"), (at(9), "1", "second")], "valid_from timestamp_ntz, k string, v string")
    found = resolve_codes_as_of(rows, versions, ["c"], "at").groupBy("at", "c").count().collect()
    assert {tuple(r) for r in found} == {(at(0), "", 10), (at(3), "first", 10), (at(6), "first", 10), (at(9), "second", 10), (None, "", 2)}
    # Four times and the absent one are sorted into ranges, with no other column.
    assert seen == [(2, 5)]


def live_files(spark, root, batch_id, oldest):
    ledger = Ledger(spark, root, spark.table("one").schema["id"].dataType, spark.table("one").schema["received_at"].dataType)
    return ledger.live(batch_id, oldest)


def test_the_ledger_is_joined_where_it_lies(spark, tmp_path):
    schema = "id string, received_at timestamp_ntz, seq long"
    spark.createDataFrame([("a", START, 0)], schema).createOrReplaceTempView("one")
    root, sizes = str(tmp_path), {}
    for n in range(12):
        batch = spark.createDataFrame([(f"k{i}", START + timedelta(days=n, minutes=i), 100 * n + i) for i in range(20)], schema)
        verdicts = decide_batch(batch, n, root, "id", "received_at", "seq")
        assert verdicts.where("accepted").count() == 20
        sizes[n] = len(live_files(spark, root, n, START + timedelta(days=n)).inputFiles()) if n else 0
    # All batches' entries are still there; what a batch reads doesn't grow with the batches before it.
    assert spark.read.parquet(f"{root}/ledger").count() == 12 * 20
    assert max(sizes[n] for n in range(8, 12)) <= max(sizes[n] for n in range(1, 5))
    live = live_files(spark, root, 12, START + timedelta(days=11))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arrived = spark.createDataFrame([("k1",), ("k2",)], "k string")
        joined = live.join(arrived, "k", "left_semi").groupBy("k").agg(F.max("expires_at"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("Scan parquet"):]
        assert "Bucketed: true" in side and plan.count("Exchange") == 1
        assert joined.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_arrivals_name_their_buckets(spark, tmp_path):
    schema = "id string, received_at timestamp_ntz, seq long"
    spark.createDataFrame([("a", START, 0)], schema).createOrReplaceTempView("one")
    batch = spark.createDataFrame([(f"k{i}", START, i) for i in range(500)], schema)
    decide_batch(batch, 0, str(tmp_path), "id", "received_at", "seq")
    ledger = Ledger(spark, str(tmp_path), batch.schema["id"].dataType, batch.schema["received_at"].dataType)
    plan = ledger.live(1, START, ["k7"]).groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of" in plan and "Exchange" not in plan


def test_a_batch_over_many_days_writes_few_folders(spark, tmp_path):
    root, schema = str(tmp_path), "id string, received_at timestamp_ntz, seq long"
    spark.createDataFrame([("a", START, 0)], schema).createOrReplaceTempView("one")
    rows = [(f"k{i}", START + timedelta(days=i, minutes=i), i) for i in range(200)] + [("far", datetime(9000, 1, 1), 999), ("none", None, 1000)]
    batch = spark.createDataFrame(rows, schema)
    for _ in range(2):
        decide_batch(batch, 0, root, "id", "received_at", "seq")
        stored = spark.read.parquet(f"{root}/ledger")
        assert stored.count() == 202
        assert stored.select("expires_day").distinct().count() <= SLICES + 1
        # No entry outlives its folder.
        assert stored.where("expires_at >= date_add(expires_day, 1)").isEmpty()
    kept = {r["k"] for r in live_files(spark, root, 1, START + timedelta(days=150)).collect()}
    assert kept == {f"k{i}" for i in range(149, 200)} | {"far"}
    late = spark.createDataFrame([("k150", START + timedelta(days=150, hours=20), 2000), ("k150", START + timedelta(days=152), 2001)], schema)
    assert {r["seq"]: r["accepted"] for r in decide_batch(late, 1, root, "id", "received_at", "seq").collect()} == {2000: False, 2001: True}

"""Streaming intake: restart, rerun, refreshed side data, failing sinks."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dockyard.operators.ttl import accepted_arrivals
from dockyard.schema import LANDED_ORDER
from dockyard.sinks.records import write_batch
from dockyard.sources.landing import land_documents, read_orders, stream_orders
from dockyard.streaming.commits import pending, read_committed, record_commit
from dockyard.streaming.intake import decide_batch, start_dedup, start_intake

START = datetime(2024, 1, 1, 0, 0, 0, 123456)


def land(spark, path, *docs):
    rows = [(START + timedelta(hours=h), seq, b if isinstance(b, str) else json.dumps(b)) for h, seq, b in docs]
    land_documents(spark.createDataFrame(rows, LANDED_ORDER), path)


def table(spark, root, name):
    return spark.read.parquet(f"{root}/{name}")


@pytest.fixture
def intake(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "out")
    names = {"1": "first"}

    def run(**options):
        dictionary = lambda: spark.createDataFrame(list(names.items()), "k string, v string")
        start_intake(stream_orders(spark, landing), root, dictionary, lambda: {"id": "cr_id"}, **options).awaitTermination()

    return landing, root, names, run


def test_intake_over_restarts(spark, intake):
    landing, root, names, run = intake
    land(spark, landing, (0, 1, {"id": "a", "homebaseId": "1"}), (1, 2, {"id": "a"}), (1, 3, {"id": ""}), (1, 4, "not json"))
    run()
    names["1"] = "second"
    land(spark, landing, (2, 5, {"id": "a"}), (2, 6, {"id": ""}), (24, 7, {"id": "a", "homebaseId": "1"}), (24, 8, {"id": "b", "lineItems": []}))
    run()

    orders = {r["seq"]: r for r in table(spark, root, "orders").collect()}
    assert set(orders) == {1, 3, 6, 7}
    assert (orders[1]["homebaseId"], orders[7]["homebaseId"]) == ("first", "second")
    assert orders[1]["received_at"] == START
    assert table(spark, root, "records").columns[0] == "cr_id"
    assert table(spark, root, "records").count() == 4
    codes = {r["seq"]: r["code"] for r in table(spark, root, "outcomes").collect()}
    assert codes == {1: 200, 2: 409, 3: 200, 5: 409, 6: 200, 7: 200}
    assert {(r["seq"], r["reason"]) for r in table(spark, root, "quarantine").collect()} == {(4, "malformed"), (8, "empty_line_items")}
    log = {(r["description"], r["message"]) for r in table(spark, root, "error_log").collect()}
    assert log == {
        ("Duplicated OE a", "Duplicated OE received"),
        ("failed to read order document", "malformed"),
        ("failed to read order document", "empty_line_items"),
    }


def test_failing_sinks_are_logged_and_the_others_go_on(spark, intake):
    landing, root, _, run = intake

    def fail(*_):
        raise OSError("no room")

    land(spark, landing, (0, 1, {"id": "a"}), (1, 2, {"id": "a"}))
    run(append_sink=fail)
    assert {r["seq"]: r["code"] for r in table(spark, root, "outcomes").collect()} == {1: 200, 2: 409}
    assert table(spark, root, "records").count() == 1
    land(spark, landing, (30, 3, {"id": "b"}))
    run(record_sink=fail)
    last = table(spark, root, "outcomes").where("seq = 3").first()
    assert (last["status"], last["message"], last["code"]) == ("failed", "Upload failed", 500)
    assert {r["seq"] for r in table(spark, root, "orders").collect()} == {1, 3}
    log = {(r["description"], r["message"]) for r in table(spark, root, "error_log").collect()}
    assert {("failed to write orders", "no room"), ("failed to write records", "no room")} <= log
    land(spark, landing, (31, 4, {"id": "b"}))
    run()
    assert table(spark, root, "outcomes").where("seq = 4").first()["code"] == 409
    # What the sinks failed to write was written before the next batch, once.
    assert sorted(r["seq"] for r in table(spark, root, "orders").collect()) == [1, 3]
    assert table(spark, root, "records").count() == 2


def test_a_restart_without_new_data_repairs_a_sink(spark, intake):
    landing, root, _, run = intake

    def fail(*_):
        raise OSError("no room")

    land(spark, landing, (0, 1, {"id": "a"}), (1, 2, {"id": "b"}))
    run(append_sink=fail)
    assert pending(spark, root, "orders") == {0} and read_committed(spark, root, "records").count() == 2
    run(append_sink=fail)
    assert pending(spark, root, "orders") == {0}
    run()
    assert sorted(r["seq"] for r in read_committed(spark, root, "orders").collect()) == [1, 2]
    assert pending(spark, root, "orders") == set()


def test_a_batch_is_kept_as_a_table_without_the_texts_of_good_documents(spark, intake):
    landing, root, _, run = intake
    plans = []

    def sink(rows, folder, batch_id):
        plans.append(rows._jdf.queryExecution().toString())
        write_batch(rows, folder, batch_id)

    long = {"id": "a", "volume": {"value": "7", "other": "x" * 1000}, "date": None}
    land(spark, landing, (0, 1, long), (1, 2, "not json"), (2, 3, {"id": "b", "lineItems": None}), (3, 4, None))
    run(append_sink=sink)
    # Nothing is cached, so a batch may be larger than the executors' memory.
    assert plans and not any("InMemoryRelation" in plan for plan in plans)
    kept = {r["seq"]: r["body"] for r in table(spark, root, "work/parsed").collect()}
    assert kept == {1: None, 2: "not json", 3: '{"id": "b", "lineItems": null}', 4: "null"}
    row = table(spark, root, "orders").first()
    assert (row["id"], row["volume_value"], row["volume_unit"], row["date"], row["teamId"]) == ("a", "7", "", None, "")
    assert {(r["seq"], r["reason"]) for r in table(spark, root, "quarantine").collect()} == {(2, "malformed"), (3, "null_object"), (4, "malformed")}


def test_landed_documents_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("dockyard.sources.landing.FILE_ROWS", 3)
    body = json.dumps({"id": "ä\n", "text": "again and again " * 200}, ensure_ascii=False)
    rows = [(START + timedelta(hours=n), n, body) for n in range(10)] + [(None, 10, None)]
    land_documents(spark.createDataFrame(rows, LANDED_ORDER).coalesce(1), str(tmp_path / "landing"))
    files = list((tmp_path / "landing").glob("part-*"))
    assert len(files) == 4 and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) * 10 < 10 * len(body)
    found = read_orders(spark, str(tmp_path / "landing"))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == rows
    # Plain files land beside them as before.
    found.where("seq = 9").write.mode("append").json(str(tmp_path / "landing"))
    assert read_orders(spark, str(tmp_path / "landing")).count() == 12


def test_readers_see_whole_batches_only(spark, tmp_path):
    root = str(tmp_path)
    for n in (0, 1, 2):
        spark.range(n, n + 1).write.parquet(f"{root}/orders/batch_id={n}")
    assert read_committed(spark, root, "orders").count() == 0
    record_commit(spark, root, 0, ["orders"])
    record_commit(spark, root, 2, ["orders", "records"])
    record_commit(spark, root, 2, ["orders"])
    assert sorted(r["id"] for r in read_committed(spark, root, "orders").collect()) == [0, 2]


def test_late_orders_take_the_names_of_their_time(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "out")
    schema = "valid_from timestamp_ntz, k string, v string"
    first = [(START - timedelta(days=1), "1", "old")]
    for docs, known in (
        [((0, 1, {"id": "a", "homebaseId": "1"}),), first],
        [((9, 2, {"id": "b", "homebaseId": "1"}), (1, 3, {"id": "c", "homebaseId": "1"})), [*first, (START + timedelta(hours=5), "1", "new")]],
    ):
        land(spark, landing, *docs)
        versions = spark.createDataFrame(known, schema)
        start_intake(stream_orders(spark, landing), root, None, lambda: {}, versions=lambda: versions).awaitTermination()  # noqa: B023
    assert {r["seq"]: r["homebaseId"] for r in read_committed(spark, root, "orders").collect()} == {1: "old", 2: "new", 3: "old"}


def test_a_batch_run_again_decides_the_same(spark, tmp_path):
    root = str(tmp_path)
    schema = "id string, received_at timestamp_ntz, seq long"
    first = spark.createDataFrame([("a", START, 1)], schema)
    second = spark.createDataFrame([("a", START + timedelta(hours=1), 2), ("b", START, 3)], schema)
    decide_batch(first, 0, root, "id", "received_at", "seq")
    for _ in range(2):
        verdicts = decide_batch(second, 1, root, "id", "received_at", "seq")
        assert {r["seq"]: r["accepted"] for r in verdicts.collect()} == {2: False, 3: True}
    ledger = spark.read.parquet(f"{root}/ledger")
    assert {(r["k"], r["batch_id"]) for r in ledger.collect()} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize("size", [1, 2, 5, 20])
def test_verdicts_do_not_depend_on_how_arrivals_fall_into_batches(spark, tmp_path, size):
    schema = "id string, received_at timestamp_ntz, seq long"
    hours = [0, 1, 23, 24, 30, 47.5, 48, 60, 100, 101]
    rows = [(key, START + timedelta(hours=h), 2 * i + j) for i, h in enumerate(hours) for j, key in enumerate("ab")]
    root = str(tmp_path)
    for n in range(0, len(rows), size):
        batch = spark.createDataFrame(rows[n : n + size], schema)
        decide_batch(batch, n // size, root, "id", "received_at", "seq")
    accepted = {r["seq"] for r in table(spark, root, "verdicts").where("accepted").collect()}
    assert accepted == {0, 1, 6, 7, 12, 13, 16, 17}


def test_a_late_arrival_is_refused_however_many_batches_lie_between(spark, tmp_path):
    schema, root = "id string, received_at timestamp_ntz, seq long", str(tmp_path)
    batches = [("a", 0, 1), *[("b", 72 + n, 10 + n) for n in range(4)], ("a", 1, 99)]
    for n, (key, hour, seq) in enumerate(batches):
        batch = spark.createDataFrame([(key, START + timedelta(hours=hour), seq)], schema)
        verdicts = decide_batch(batch, n, root, "id", "received_at", "seq")
    assert [r["accepted"] for r in verdicts.collect()] == [False]


def test_verdicts_do_not_depend_on_the_session_time_zone(spark, tmp_path):
    schema = "id string, received_at timestamp_ntz, seq long"
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        for n, hours in enumerate([0, 23, 24, 25]):
            batch = spark.createDataFrame([("a", START + timedelta(hours=hours), n)], schema)
            decide_batch(batch, n, str(tmp_path), "id", "received_at", "seq")
        accepted = {r["seq"] for r in table(spark, str(tmp_path), "verdicts").where("accepted").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert accepted == {0, 2}


def test_a_batch_without_arrivals_keeps_the_ledger(spark, tmp_path):
    root, schema = str(tmp_path), "id string, received_at timestamp_ntz, seq long"
    batches = [[("a", START, 1)], [], [("a", START + timedelta(hours=1), 2)]]
    for n, batch in enumerate(batches):
        verdicts = decide_batch(spark.createDataFrame(batch, schema), n, root, "id", "received_at", "seq")
    assert [r["accepted"] for r in verdicts.collect()] == [False]


def test_stream_equals_batch_with_hot_ids(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "out")
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("id"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 7 % 1009, hours=F.col("id").cast("int") / 100)).alias("received_at"),
        F.col("id").alias("seq"),
    )
    cut = F.lit(START + timedelta(hours=20)).cast("timestamp_ntz")
    for part in [rows.where(F.col("received_at") < cut), rows.where(F.col("received_at") >= cut)]:
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        start_dedup(stream, root, "id", "received_at", "seq", timedelta(hours=2), group_bound=100).awaitTermination()
    got = table(spark, root, "verdicts").where("accepted").select("seq")
    want = accepted_arrivals(rows, ttl=timedelta(hours=2), group_bound=3000).select("seq")
    assert got.count() > 50
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_landed_documents_keep_microseconds(spark, tmp_path):
    land(spark, str(tmp_path / "l"), (0, 1, {"id": "a"}))
    assert read_orders(spark, str(tmp_path / "l")).first()["received_at"] == START

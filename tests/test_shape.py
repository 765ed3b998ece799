"""Projections, renames, records, limits, lookups."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dockyard.operators import shape
from dockyard.operators.lookup import first_match_wins, unseen
from dockyard.operators.outcomes import outcome_rows, status_board
from dockyard.operators.shape import (
    clean_payload,
    limit_rows,
    number_rows,
    project_by_name,
    project_by_position,
    rename_columns,
    rows_to_records,
)


@pytest.fixture
def repeated(spark):
    """Headers may repeat and differ by case only."""
    return spark.createDataFrame([("1", "2", "3", "4")], "w string, x string, y string, z string").toDF("a", "A", "a", "b")


def test_project_by_name(repeated):
    out = project_by_name(repeated, ["b", "nope", "a", "A", "B"])
    assert out.columns == ["b", "a", "A"]
    assert tuple(out.first()) == ("4", "1", "2")


def test_project_by_position(repeated):
    assert tuple(project_by_position(repeated, [0, -1, 99]).first()) == ("1", "4")
    with pytest.raises(IndexError):
        project_by_position(repeated, [-5])


def test_rename_keeps_last_of_colliding_names(repeated):
    out = rename_columns(repeated, {"b": "A", "x": "unused"})
    assert out.columns == ["a", "A"]
    assert tuple(out.first()) == ("3", "4")


def test_rename_is_case_exact(spark):
    assert rename_columns(spark.range(1), {"ID": "other"}).columns == ["id"]


def test_records_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, "x")], "n int, v string, t string")
    assert rows_to_records(df).first()["record"] == '{"n":1,"v":null,"t":"x"}'
    assert rows_to_records(df, ["t"]).columns == ["n", "v", "record"]


def test_clean_payload(spark):
    df = spark.createDataFrame(
        [(" 12 ", "2025-6-1", "--", "gone"), ("5.", "12", "-4", "gone")], "a string, d string, b string, c string"
    )
    mapping = {"a": "cr_a", "d": "cr_LastDate", "b": "cr_b", "c": "", "other": "cr_o"}
    got = [r["record"] for r in rows_to_records(clean_payload(df, mapping)).collect()]
    assert got == [
        '{"cr_a":12,"cr_LastDate":"2025-06-01T00:00:00Z","cr_b":null}',
        '{"cr_a":5.0,"cr_LastDate":"12","cr_b":"-4"}',
    ]


def test_clean_payload_last_target_wins(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    assert rows_to_records(clean_payload(df, {"a": "t", "b": "t"})).first()["record"] == '{"t":2}'


def test_limit_counts_the_header(spark):
    df = spark.range(20)
    assert limit_rows(df, 10, "id").count() == 9
    assert limit_rows(df, 1, "id").count() == 0
    assert limit_rows(df, 0, "id").count() == 20
    with pytest.raises(ValueError):
        limit_rows(df, -1, "id")


def test_large_limit_takes_no_heap(spark, monkeypatch):
    monkeypatch.setattr(shape, "TOP_K_BOUND", 10)
    df = spark.range(1000).select((999 - F.col("id")).alias("id"))
    assert [r["id"] for r in limit_rows(df, 500, "id").collect()] == list(range(499))


def test_number_rows(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    assert all(r["v"] + 2 == r["_pos"] for r in number_rows(df, "v", start=2).collect())
    assert number_rows(df.where("v < 0"), "v").count() == 0


def test_first_match(spark):
    df = spark.createDataFrame([("k", "second", 2), ("k", "first", 1)], "k string, v string, pos int")
    assert first_match_wins(df, "k", "v", "pos").first()["v"] == "first"


def test_unseen(spark):
    now = datetime(2024, 1, 5)
    ledger = spark.createDataFrame(
        [("live", datetime(2024, 1, 6)), ("over", now), ("ever", None), ("live", datetime(2024, 1, 7))],
        "k string, expires_at timestamp_ntz",
    )
    incoming = spark.createDataFrame([("live",), ("over",), ("ever",), ("new",), ("new",)], "k string")
    out = unseen(incoming, ledger, "k", F.lit(now).cast("timestamp_ntz"))
    assert sorted(r["k"] for r in out.collect()) == ["new", "new", "over"]


def test_outcomes(spark):
    rows = [("a", True, False), ("b", False, False), ("c", True, True), ("d", False, True)]
    df = spark.createDataFrame(rows, "id string, accepted boolean, broken boolean").withColumn(
        "received_at", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    )
    out = outcome_rows(df, sink_failed=F.col("broken")).orderBy("uploaded_oe").collect()
    assert [(r["status"], r["message"], r["code"]) for r in out] == [
        ("success", "Upload successful", 200),
        ("failed", "Duplicated OE received. Upload denied.", 409),
        ("failed", "Upload failed", 500),
        ("failed", "Duplicated OE received. Upload denied.", 409),
    ]
    assert out[0]["date_received"] == "2024-01-01 08:00:00 AM"


def test_status_board(spark):
    rows = [(1, "progress", "10%", 1), (1, "progress", "20%", 2), (1, "runs", "3", 1), (2, "duration", "5s", 1),
            (2, "other", "x", 9)]
    df = spark.createDataFrame(rows, "row_no int, field string, value string, seq long").withColumn("at", F.col("seq"))
    assert {tuple(r) for r in status_board(df).collect()} == {(1, "20%", "3", None), (2, None, None, "5s")}


def test_a_code_that_occurs_twice_does_not_multiply_rows(spark):
    from dockyard.operators.lookup import resolve_codes

    orders = spark.createDataFrame([("1",), ("2",), ("3",)], "code string")
    dictionary = spark.createDataFrame([("1", "old"), ("2", "two"), ("1", "new"), ("2", None)], "k string, v string").coalesce(1)
    assert [r["code"] for r in resolve_codes(orders, dictionary, ["code"]).collect()].count("new") == 1
    assert sorted(map(str, (r["code"] for r in resolve_codes(orders, dictionary, ["code"]).collect()))) == ["", "None", "new"]

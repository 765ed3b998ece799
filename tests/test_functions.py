"""Cells, dates, expiries and texts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dockyard.functions.cells import clean_cell, clean_text
from dockyard.functions.text import WORKSPACE_PATTERN, base_name, mask_middle, url_groups, url_param
from dockyard.functions.times import epoch_micros, normalise_date, normalise_expiry, received_at_local


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("cell, json", [
    (" 12 ", "12"), ("007", "7"), ("5.", "5.0"), (".5", "0.5"), ("1.25", "1.25"),
    ("-4", '"-4"'), ("1e5", '"1e5"'), ("12,000", '"12,000"'), (".", '"."'), ("1.2.3", '"1.2.3"'),
    ("-", '"-"'), ("n/a", '"n/a"'), ("", None), ("  ", None), ("--", None), (" N/A\t", None), (None, None),
    ("99999999999999999999", "99999999999999999999"),
])
def test_clean_cell(spark, cell, json):
    assert one(spark, lambda c: F.to_json(F.struct(clean_cell(c, False).alias("v"))), cell) == (
        "{}" if json is None else f'{{"v":{json}}}'
    )


@pytest.mark.parametrize("cell, text", [
    ("2025-06-01", "2025-06-01T00:00:00Z"), ("2025-6-1", "2025-06-01T00:00:00Z"), (" 2025-6-1 ", "2025-06-01T00:00:00Z"),
    ("2025-02-30", "2025-02-30"), ("2025-06-01T00:00:00", "2025-06-01T00:00:00"), ("12", "12"), ("--", None),
])
def test_date_cell(spark, cell, text):
    assert one(spark, lambda c: clean_cell(c, True).cast("string"), cell) == text


def test_trim_takes_all_white_space(spark):
    assert one(spark, clean_text, " \t a b　\n\x1c") == "a b"


def test_normalise_date_keeps_null(spark):
    assert one(spark, normalise_date, None) is None


@pytest.mark.parametrize("text, expiry", [
    (None, "2024-01-03T04:05:06.000007"), ("", "2024-01-03T04:05:06.000007"),
    ("2025-06-01", "2025-06-01T00:00:00"), ("2025-6-1", "2025-06-01T23:59:59"),
    ("2025-06-01T10:00", "2025-06-01T10:00:00"), ("2025-06-01 10:00:01.5", "2025-06-01T10:00:01.500000"),
    ("20250601", "2025-06-01T00:00:00"), ("20250601T101112", "2025-06-01T10:11:12"),
    ("2025-02-30", None), ("2025-13-1", None), ("soon", None),
    ("2025-06-01T00:00:00Z", "2025-06-01T00:00:00"), ("2025-06-01T01:00:00.5+02:00", "2025-05-31T23:00:00.500000"),
    ("2025-06-01 01:00-0330", "2025-06-01T04:30:00"), ("2025-06-01Z", None), ("2025-02-30T00:00Z", None),
])
def test_normalise_expiry(spark, text, expiry):
    now = F.lit(datetime(2024, 1, 2, 4, 5, 6, 7)).cast("timestamp_ntz")
    assert one(spark, lambda c: normalise_expiry(c, now), text) == expiry


def test_received_at_local(spark):
    naive = lambda c: received_at_local(c.cast("timestamp_ntz"))
    assert one(spark, naive, "2024-01-01 16:00:07.179575") == "2024-01-02 12:00:07 AM"
    instant = lambda c: received_at_local(c.cast("timestamp"), naive_utc=False)
    assert one(spark, instant, "2024-01-01 04:30:00") == "2024-01-01 12:30:00 PM"


def test_skipped_hours_are_kept(spark):
    """02:30 does not exist in New York on this day, but it is a good UTC wall clock."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        naive = lambda c: c.cast("timestamp_ntz")
        assert one(spark, lambda c: received_at_local(naive(c)), "2024-03-09 18:30:00") == "2024-03-10 02:30:00 AM"
        assert one(spark, lambda c: normalise_expiry(c, naive(c)), "2024-03-10T02:30") == "2024-03-10T02:30:00"
        assert one(spark, lambda c: epoch_micros(naive(c)), "2024-03-10 02:30:00") == 1_710_037_800_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_epoch_micros(spark):
    micros = lambda c: epoch_micros(c.cast("timestamp_ntz"))
    assert one(spark, micros, "1970-01-02 00:00:01.000005") == 86_401_000_005
    assert one(spark, micros, "1969-12-31 23:59:59.5") == -500_000


@pytest.mark.parametrize("url, value", [
    ("http://a/b?code=x%20y+z&code=2", "x y z"), ("http://a/b?code=&code=x", "x"), ("http://a/b?code=", None),
    ("http://a/b#?code=x", None), ("http://a/b?q=1&code=x#y", "x"), ("http://a/b?xcode=1", None),
    ("http://a/b?code=%zz+1", "%zz 1"), ("http://a/b", None),
])
def test_url_param(spark, url, value):
    assert one(spark, lambda c: url_param(c, "code"), url) == value


def test_url_groups(spark):
    first = lambda c: url_groups(c, WORKSPACE_PATTERN, 2)[0]
    assert one(spark, first, "https://x/groups/ab-1/lakehouses/c_2?x=1") == "ab-1"
    assert one(spark, first, "https://x/groups/ab-1") is None


def test_mask_and_base_name(spark):
    assert one(spark, lambda c: mask_middle(c, 3), "abcdefg") == "abc...efg"
    assert one(spark, lambda c: mask_middle(c, 3), "abcdef") == "..."
    assert one(spark, base_name, "/a/b/c.csv") == "c.csv"

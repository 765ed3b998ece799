"""Order documents: absent, null and empty kept apart; quarantine reasons."""

import json
from datetime import datetime

import pytest

from dockyard.operators.lookup import dict_last_wins
from dockyard.operators.orders import flatten_orders, land_orders, parse_orders
from dockyard.schema import ORDER_COLUMNS

ALL_BLANK = {
    "id": "", "type": "DROP", "sourceOrderId": "", "teamId": "",
    "lineItems": [{"id": "", "quantity": "", "quantityUnit": "", "price": {"amount": "", "currency": ""}}],
    "volume": {"value": "", "unit": ""},
    "customProperties": {k: "" for k in ORDER_COLUMNS[11:20]},
    "homebaseId": "", "locationId": "", "date": "", "orderDate": "",
}
AT = datetime(2024, 3, 1, 16, 30, 5)


def parsed(spark, *bodies):
    rows = [(AT, i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return parse_orders(spark.createDataFrame(rows, "received_at timestamp_ntz, seq long, body string"))


def flat(spark, body):
    (row,) = flatten_orders(parsed(spark, body)).collect()
    return row.asDict()


def test_all_blank_document(spark):
    row = flat(spark, ALL_BLANK)
    assert list(row) == [*ORDER_COLUMNS, "received_at_local"]
    assert row.pop("type") == "DROP"
    assert row.pop("received_at_local") == "2024-03-02 12:30:05 AM"
    assert set(row.values()) == {""}


def test_unknown_keys_only(spark):
    row = flat(spark, {"message": "x"})
    assert {row[c] for c in ORDER_COLUMNS} == {""}


def test_null_is_kept_and_absent_is_blank(spark):
    row = flat(spark, {"id": "7", "teamId": None, "volume": {"value": None}, "lineItems": [{"quantity": None}],
                       "customProperties": {"LOAD_NO": None}})
    assert (row["id"], row["type"]) == ("7", "")
    assert row["teamId"] is None and row["volume_value"] is None and row["lineItem_quantity"] is None
    assert row["LOAD_NO"] is None
    assert (row["volume_unit"], row["lineItem_id"], row["SO_REF"]) == ("", "", "")


def test_first_line_item_only(spark):
    doc = {"lineItems": [{"id": "a", "price": {"amount": 5, "currency": "USD"}}, {"id": "b"}, 5]}
    (row,) = parsed(spark, doc).select("n_line_items", "reason").collect()
    assert (row["n_line_items"], row["reason"]) == (3, None)
    row = flat(spark, doc)
    assert (row["lineItem_id"], row["lineItem_price_amount"], row["lineItem_quantity"]) == ("a", "5", "")


def test_absent_line_items_and_numbers(spark):
    row = flat(spark, {"id": 7, "volume": {"value": 5}})
    assert (row["id"], row["volume_value"], row["lineItem_price_currency"]) == ("7", "5", "")


def test_key_case_is_exact(spark):
    assert flat(spark, {"Id": "7"})["id"] == ""


@pytest.mark.parametrize("body, reason", [
    ({"lineItems": []}, "empty_line_items"),
    ({"lineItems": None}, "null_object"),
    ({"lineItems": [None]}, "null_object"),
    ({"lineItems": [{"price": None}]}, "null_object"),
    ({"volume": None}, "null_object"),
    ({"customProperties": None}, "null_object"),
    ({"lineItems": [{"price": 5}]}, "malformed"),
    ({"lineItems": [5]}, "malformed"),
    ({"lineItems": {}}, "malformed"),
    ({"volume": 5}, "malformed"),
    ({"customProperties": []}, "malformed"),
    ("[{\"id\":\"1\"}]", "malformed"),
    ("5", "malformed"),
    ("null", "malformed"),
    ("xx", "malformed"),
    ("", "malformed"),
    (None, "malformed"),
    ("{\"id\":\"1\"", "malformed"),
    ("{\"id\":\"1\"} more", "malformed"),
    ("{\"id\":\"1\"}{\"id\":\"2\"}", "malformed"),
    ("{'id':'1'}", "malformed"),
    ({}, None),
    (" {\"id\": \"1\"}\n", None),
])
def test_quarantine_reason(spark, body, reason):
    df = parsed(spark, body)
    assert df.first()["reason"] == reason
    assert flatten_orders(df).count() == (reason is None)


def test_codes_resolve_last_wins_and_miss_is_blank(spark):
    entries = spark.createDataFrame(
        [("1", "old", 1), ("1", "new", 2), ("2", None, 3), ("", "none given", 4)], "k string, v string, pos int"
    )
    dictionary = dict_last_wins(entries, "k", "v", "pos")
    docs = parsed(spark, {"homebaseId": "1", "locationId": "9"}, {"homebaseId": "2"}, {"homebaseId": None, "locationId": "1"})
    rows = land_orders(docs, dictionary, keep=["seq"]).orderBy("seq").collect()
    got = [(r["homebaseId"], r["locationId"]) for r in rows]
    assert got == [("new", ""), (None, "none given"), ("", "new")]


def test_each_json_parse_runs_once(spark):
    df = flatten_orders(parsed(spark, {}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 3

"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import clean_text, float_value, int_value
from ..functions.text import mask_middle, url_groups, url_param
from ..functions.times import normalise_date, normalise_expiry, received_at_local, time_literal
from ..operators.cache import checked_expiry, current_entries, evict, get_or_compute, missing_keys, put_entries
from ..operators.entries import EntryStore
from ..operators.lookup import dict_last_wins, first_match_wins, resolve_codes, unseen
from ..operators.orders import cell, flatten_orders, land_orders, parse_orders
from ..operators.outcomes import board_cells, error_log, outcome_rows, read_board, status_board, upsert_board
from ..operators.shape import (
    clean_payload,
    limit_rows,
    number_rows,
    project_by_name,
    project_by_position,
    rename_columns,
    rows_to_records,
)
from ..operators.ttl import accepted_arrivals, classify_arrivals, drop_repeats
from ..schema import ORDER_COLUMNS
from ..session import materialise, new_folder, shuffles_dropped
from ..sinks.envelope import CRLF, batch_envelopes, batch_records
from ..sinks.files import load_table, stage_csv, write_csv
from ..sinks.records import record_documents, record_rows
from ..sources.landing import land_documents, stream_orders
from ..sources.pages import column_dictionary, linked_scan, paged_scan, table_dictionary, union_pages
from ..sources.tables import range_slice, read_csv
from ..streaming.commits import read_committed
from ..streaming.intake import decide_batch, start_dedup, start_intake
from .inputs import (
    SENT_AT_HOURS,
    arrivals,
    damaged_documents,
    linked_pages,
    location_dictionary,
    order_documents,
    order_pages,
    page_link,
    record_pages,
    sendings,
    sent_documents,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The instant at which the cache and ledger queries look.
NOW = datetime(2024, 1, 15)

# Logical names of the record table's columns; a name without an entry is kept.
LOGICAL = {name: f"cr_{name.lower()}" for name in ORDER_COLUMNS if name not in ("sourceOrderId", "teamId")}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _now() -> Column:
    return time_literal(NOW)


# Orders


@query("order_flatten")
def order_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return land_orders(parse_orders(order_documents(spark, sf_dir)), location_dictionary(spark, sf_dir))


@query("record_sink_rows")
def record_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_rows(order_flatten(spark, sf_dir), LOGICAL)


@query("record_sink_documents")
def record_sink_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = order_flatten(spark, sf_dir)
    return record_documents(flat, LOGICAL)


@query("first_line_item")
def first_line_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_orders(order_documents(spark, sf_dir))
    return parsed.where("n_line_items > 0").select(
        "o_orderkey",
        cell("lineItem_id").cast("long").alias("l_partkey"),
        cell("lineItem_price_amount").cast("decimal(14,2)").alias("amount"),
        F.col("n_line_items").cast("long").alias("n_line_items"),
    )


@query("quarantine_routing")
def quarantine_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_orders(damaged_documents(spark, sf_dir))
    return parsed.select("o_orderkey", F.coalesce("reason", F.lit("accepted")).alias("route"))


@query("order_intake")
def order_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents flattened once into a table, repeats then refused by its id column."""
    parsed = parse_orders(sent_documents(spark, sf_dir))
    flat = land_orders(parsed, location_dictionary(spark, sf_dir), keep=["received_at", "seq"])
    staged = materialise(flat, new_folder(spark, "flat-orders"))
    return drop_repeats(staged).drop("received_at", "seq")


@query("stream_order_intake")
def stream_order_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the stream, each sending as its own landing and restart."""
    root, landing = new_folder(spark, "intake"), new_folder(spark, "landing")
    # Stored once per order; the copies differ by time and number alone.
    with shuffles_dropped(spark):
        docs = sendings(materialise(order_documents(spark, sf_dir), new_folder(spark, "documents"), "zstd"))
    for copy in range(len(SENT_AT_HOURS)):
        land_documents(docs.where(F.col("copy") == copy), landing)
        start_intake(
            stream_orders(spark, landing), root, lambda: location_dictionary(spark, sf_dir), lambda: LOGICAL
        ).awaitTermination()
    return spark.read.parquet(f"{root}/orders").drop("received_at", "seq", "batch_id")


@query("stream_sink_failure")
def stream_sink_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table's only write fails; a restart writes it, though nothing new has landed."""
    root, landing = new_folder(spark, "intake"), new_folder(spark, "landing")

    def fail(*_) -> None:
        raise OSError("no room")

    docs = order_documents(spark, sf_dir)
    with shuffles_dropped(spark):
        land_documents(docs, landing)
    for sink in (fail, None):
        start_intake(
            stream_orders(spark, landing), root, lambda: location_dictionary(spark, sf_dir), lambda: LOGICAL, append_sink=sink
        ).awaitTermination()
    return read_committed(spark, root, "orders").drop("received_at", "seq", "batch_id")


# From this time on the dictionary has other names.
RENAMED_AT = datetime(1998, 6, 1)


@query("stream_side_refresh")
def stream_side_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary changes between two batches, and odd orders land late; each takes the names of its receipt time."""
    root, landing = new_folder(spark, "intake"), new_folder(spark, "landing")
    names = location_dictionary(spark, sf_dir)
    old = names.select(time_literal(datetime(1970, 1, 1)).alias("valid_from"), "k", "v")
    new = names.select(time_literal(RENAMED_AT).alias("valid_from"), "k", F.concat("v", F.lit(" (new)")).alias("v"))
    with shuffles_dropped(spark):
        docs = materialise(order_documents(spark, sf_dir), new_folder(spark, "documents"), "zstd")
    cut = time_literal(RENAMED_AT)
    # The first batch knows the old names alone, and holds the even orders of their time; the second one has all others.
    early = (F.col("o_orderkey") % 2 == 0) & (F.col("received_at") < cut)
    for part, known in ((docs.where(early), old), (docs.where(~early), old.unionByName(new))):
        land_documents(part, landing)
        start_intake(stream_orders(spark, landing), root, None, lambda: LOGICAL, versions=lambda: known).awaitTermination()  # noqa: B023
    return read_committed(spark, root, "orders").drop("received_at", "seq", "batch_id")


# Repeats


@query("ttl_dedup")
def ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir)
    accepted = accepted_arrivals(rows, "id", "ts", "event_id").select("event_id")
    return rows.join(accepted, "event_id", "left_semi").select("event_id", "user_id", "ts")


@query("ttl_dedup_hot")
def ttl_dedup_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ids hold all arrivals, so chunk walks decide them; TTL five days."""
    rows = table(spark, sf_dir, "events")
    verdicts = classify_arrivals(rows, "event_type", "ts", "event_id", timedelta(days=5), group_bound=100, chunk_rows=2_000)
    return verdicts.select("event_type", "event_id", "accepted")


@query("stream_ttl_dedup")
def stream_ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``ttl_dedup``, landed in three slices of time with a restart after each."""
    root, landing = new_folder(spark, "dedup"), new_folder(spark, "landing")
    rows = arrivals(spark, sf_dir)
    cuts = [datetime(2024, 1, 11), datetime(2024, 1, 21)]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows
        if low:
            part = part.where(F.col("ts") >= time_literal(low))
        if high:
            part = part.where(F.col("ts") < time_literal(high))
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        start_dedup(stream, root, "id", "ts", "event_id").awaitTermination()
    accepted = spark.read.parquet(f"{root}/verdicts").where("accepted").select("event_id")
    return rows.join(accepted, "event_id", "left_semi").select("event_id", "user_id", "ts")


@query("ledger_bucketed")
def ledger_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in six batches against the stored ledger, each reading what can still refuse something."""
    root = new_folder(spark, "ledger")
    rows = arrivals(spark, sf_dir)
    cuts = [datetime(2024, 1, 1) + timedelta(days=5 * n) for n in range(1, 6)]
    for number, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = rows
        if low:
            part = part.where(F.col("ts") >= time_literal(low))
        if high:
            part = part.where(F.col("ts") < time_literal(high))
        decide_batch(part.select("id", "ts", "event_id"), number, root, "id", "ts", "event_id")
    accepted = spark.read.parquet(f"{root}/verdicts").where("accepted").select("event_id")
    return rows.join(accepted, "event_id", "left_semi").select("event_id", "user_id", "ts")


@query("outcome_rows")
def outcome_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = classify_arrivals(arrivals(spark, sf_dir), "id", "ts", "event_id")
    return outcome_rows(verdicts, "id", "ts", keep=["event_id"])


@query("ledger_anti_join")
def ledger_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").where(F.col("ts") <= _now())
    ledger = bought.select("user_id", (F.col("ts") + F.lit(timedelta(days=1))).alias("expires_at"))
    return unseen(events.select("user_id").distinct(), ledger, "user_id", _now())


# Lookups


@query("masterdata_lookup")
def masterdata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by a dictionary of several files: a large first one that repeats its codes, and a small one that renames some."""
    folder = new_folder(spark, "masterdata")
    old = table(spark, sf_dir, "customer").select(
        F.lit(1).alias("file"), F.col("c_nationkey").cast("string").alias("k"), F.concat(F.lit("old "), "c_nationkey").alias("v")
    )
    new = location_dictionary(spark, sf_dir).select(F.lit(2).alias("file"), "k", "v")
    old.unionByName(new).write.partitionBy("file").option("header", True).csv(folder)
    dictionary, _ = read_csv(spark, f"{folder}/file=*", with_position=True)
    codes = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_nationkey").cast("string").alias("homebase"),
        (F.col("c_custkey") % 30).cast("string").alias("location"),
    )
    return resolve_codes(codes, dictionary, ["homebase", "location"], pos="_pos")


def _status_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), "o_orderkey"
    )


@query("dict_last_wins")
def dictionary_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dict_last_wins(_status_by_customer(spark, sf_dir), "k", "v", "o_orderkey")


@query("first_match_wins")
def list_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_match_wins(_status_by_customer(spark, sf_dir), "k", "v", "o_orderkey")


# Cache


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event puts its id under the user for a day; a signup's entry never expires."""
    expiry = F.when(F.col("event_type") != "signup", F.col("ts") + F.lit(timedelta(days=1)))
    return put_entries(
        table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), F.col("ts"), F.col("event_id"), expiry
    )


@query("ttl_cache_lookup")
def ttl_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_entries(_entries(spark, sf_dir), _now()).select("k", "v")


@query("ttl_miss_keys")
def ttl_miss_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return missing_keys(keys, _entries(spark, sf_dir), _now())


@query("ttl_get_or_compute")
def ttl_get_or_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing users get their number of purchases, which is put and read back; those without one have no value."""
    events = table(spark, sf_dir, "events")

    def purchases(missing: DataFrame) -> DataFrame:
        # Events of other users, and other events, are dropped before anything is counted.
        bought = events.where("event_type = 'purchase'").select(F.col("user_id").alias("k"))
        return bought.join(missing, "k", "left_semi").groupBy("k").agg(F.count("*").alias("v"))

    entries = _entries(spark, sf_dir)
    _, computed = get_or_compute(events.select(F.col("user_id").alias("k")), entries, purchases, _now())
    put = put_entries(computed, F.col("k"), F.col("v"), _now(), F.lit(1 << 62), _now() + F.lit(timedelta(days=1)))
    return current_entries(entries.unionByName(put), _now()).where("v IS NOT NULL").select("k", "v")


@query("ttl_entry_store")
def ttl_entry_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with expiry text put in three parts, one of them with text that can't be read, compacted between, then looked at."""
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "signup", "2999-12-31").otherwise(F.date_format(F.col("ts") + F.lit(timedelta(days=1)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    text = F.when(F.col("event_id") % 7 == 0, "soon").otherwise(text)
    rows = events.select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.col("ts").alias("written_at"), F.col("event_id").alias("seq"), text.alias("expires_at"))
    good, _ = checked_expiry(rows, F.col("expires_at"), F.col("written_at"), "read_at")
    store = EntryStore(spark, new_folder(spark, "entries"), "k bigint, v bigint, written_at timestamp_ntz, seq bigint, expires_at string")
    for part in range(3):
        store.put(good.drop("read_at").where(F.col("v") % 3 == part))
        if part:
            store.compact(time_literal(datetime(2024, 1, 10)))
    store.compact(_now())
    return store.look(_now()).select("k", "v")


@query("expiry_normalise")
def expiry_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, way = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(way == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(way == 1, F.date_format(day, "yyyy-M-d"))
        .when(way == 2, F.date_format(day + F.lit(timedelta(minutes=90)), "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise_expiry(text, day).alias("expires_at"))


@query("expiry_offsets")
def expiry_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry text with ``Z`` and with offsets, and text that can't be read."""
    day, way = F.col("o_orderdate"), F.col("o_orderkey") % 4
    shown = F.date_format(day, "yyyy-MM-dd")
    text = (
        F.when(way == 0, F.concat(shown, F.lit("T10:30:00Z")))
        .when(way == 1, F.concat(shown, F.lit("T10:30:00+08:00")))
        .when(way == 2, F.concat(shown, F.lit(" 10:30-0330")))
        .otherwise(F.concat(F.lit("on "), shown))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise_expiry(text, day).alias("expires_at"))


@query("ttl_evict")
def ttl_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that stay when expired and replaced ones go."""
    return evict(_entries(spark, sf_dir), _now()).select("k", "v", "written_at")


# Logs


@query("error_log")
def intake_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused repeats and failed events, as the log holds them."""
    events = arrivals(spark, sf_dir)
    refused = classify_arrivals(events, "id", "ts", "event_id").where("not accepted")
    repeats = error_log(
        refused, "intake", F.col("ts"), F.concat(F.lit("Duplicated OE "), "id"), F.lit("Duplicated OE received")
    )
    failed = error_log(
        events.where("event_type = 'error'"), "intake", F.col("ts"),
        F.concat(F.lit("rejected event "), "event_id"), F.col("event_type"),
    )
    return repeats.unionByName(failed)


def _board_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = (
        F.when(F.col("event_type") == "view", "progress")
        .when(F.col("event_type") == "click", "runs")
        .when(F.col("event_type") == "purchase", "duration")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("row_no"), field.alias("field"), F.col("event_id").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("seq")
    )


@query("status_board")
def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_board(_board_updates(spark, sf_dir))


@query("status_board_incremental")
def stored_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from three batches of updates, each of all times, merged into the stored board."""
    root, updates = new_folder(spark, "boards"), _board_updates(spark, sf_dir)
    for rest in (2, 0, 1):
        upsert_board(spark, root, updates.where(F.col("seq") % 3 == rest))
    return read_board(spark, root, board_cells(updates).schema)


# Cells and texts


@query("default_fill")
def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent key, null and value of ``k`` kept apart."""
    way = F.col("event_id") % 5
    value = F.from_json("props", "k string")["k"]
    pair = F.when(way == 0, '"teamId":null,').when(way == 1, "").otherwise(F.concat(F.lit('"teamId":'), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2), F.lit(",")))
    body = F.concat(F.lit("{"), pair, F.lit('"lineItems":[{"id":"1"}]}'))
    parsed = parse_orders(table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("received_at"), body.alias("body")))
    return flatten_orders(parsed, ["event_id"]).select("event_id", F.col("teamId").alias("k"))


def _part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("p_partkey") % 7
    raw = F.lit(" 12 ")
    for number, cell in enumerate(["--", "N/A", "5.", "-4", "\t "], start=1):
        raw = F.when(way == number, cell).otherwise(raw)
    raw = F.when(way == 6, F.col("p_size").cast("string")).otherwise(raw)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", raw.alias("raw"))


@query("clean_cells")
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text, integer and float of each cell."""
    text = clean_text(F.col("raw"))
    return _part_cells(spark, sf_dir).select(
        "p_partkey",
        text.alias("text_value"),
        int_value(text).cast("long").alias("int_value"),
        float_value(text).alias("float_value"),
    )


@query("clean_payload")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records: unmapped columns dropped, cells typed by content, dates normalised."""
    cells = _part_cells(spark, sf_dir).select(
        F.col("p_partkey").cast("string").alias("No"),
        F.col("raw").alias("Value"),
        F.concat(F.lit("2024-1-"), F.col("p_partkey") % 28 + 1).alias("Loaded"),
        F.col("p_brand").alias("unmapped"),
    )
    cleaned = clean_payload(cells, {"No": "cr_no", "Value": "cr_value", "Loaded": "cr_DateLoaded"})
    return rows_to_records(cleaned, name="record")


@query("format_date")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, way = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = (
        F.when(way == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(way == 1, F.date_format(day, "yyyy-M-d"))
        .otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise_date(text).alias("cr_date"))


@query("received_at_local")
def receipt_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", received_at_local(F.col("ts")).alias("received_at_local"))


@query("url_param")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", url_param(url, "utm_source").alias("utm_source"), url_param(url, "ref").alias("ref")
    )


@query("url_path_groups")
def url_path_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = url_groups(F.col("url"), r"//[^/]+/([\w-]+)/([\w-]+)", 2)
    return table(spark, sf_dir, "pages").select("page_id", first.alias("g1"), second.alias("g2"))


@query("mask_middle")
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mask_middle(F.col("c_name"), 3).alias("masked"))


# Shape


@query("project_by_name")
def wanted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_by_name(table(spark, sf_dir, "part"), ["p_type", "nope", "P_NAME", "p_partkey"])


@query("project_by_position")
def wanted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_by_position(table(spark, sf_dir, "customer"), [0, -1, 99])


@query("rename_columns")
def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").drop("s_acctbal")
    return rename_columns(suppliers, {"s_suppkey": "cr_supplier", "s_name": "cr_name", "S_NATIONKEY": "no"})


@query("rows_to_records")
def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") != 0, F.col("c_nationkey").cast("string")).alias("parent"),
    )
    return rows_to_records(rows, ["name", "parent"])


@query("limit_rows")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 10, "o_orderkey")


@query("row_positions")
def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered by date and key, as rows of a sheet below its header."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return number_rows(orders, "o_orderdate", "o_orderkey", start=2).select("o_orderkey", "_pos")


@query("range_slice")
def sheet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns A to B from sheet row 12 down; customers stand in key order from row 2."""
    sheet = table(spark, sf_dir, "customer").withColumn("_pos", F.col("c_custkey") + 2)
    return range_slice(sheet, "A12:B")


# Pages and metadata


@query("paged_scan")
def order_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values: keys come as numbers, prices as decimals, flags as booleans."""
    rows = paged_scan(order_pages(spark, sf_dir), [0, -1, 1, 2, 99], typed=True)
    # The scan's decimals are as wide as their values.
    return rows.withColumn("price", F.col("price").cast("decimal(14,2)"))


@query("linked_scan")
def order_link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders from pages that landed in no order and name their successors."""
    rows = linked_scan(linked_pages(spark, sf_dir), page_link(0), typed=True)[0]
    return rows.withColumn("price", F.col("price").cast("decimal(14,2)"))


@query("linked_scan_notes")
def order_link_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of that landing that no link leads to, and the last page, which leads back."""
    return linked_scan(linked_pages(spark, sf_dir), page_link(0))[1].select("link", "note")


@query("page_union")
def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two page sets, the second without the status and with a column the first lacks."""
    orders = table(spark, sf_dir, "orders")
    key, half = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 2).cast("long")
    first = record_pages(orders.where(key % 2 == 0), half, [key, F.col("o_orderstatus")])
    second = record_pages(orders.where(key % 2 == 1), half, [key, F.col("o_custkey")])
    both = union_pages([paged_scan(first), paged_scan(second)])
    return both.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus")


@query("metadata_dictionary")
def metadata_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables: labelled by segment and nation, unlabelled for every fifth."""
    key = F.col("c_custkey")
    label = F.when(key % 5 != 0, F.struct(F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("Label")))
    entities = record_pages(
        table(spark, sf_dir, "customer"), key,
        [F.col("c_name").alias("LogicalName"), F.struct(label.alias("UserLocalizedLabel")).alias("DisplayName")],
    )
    return table_dictionary(entities)


@query("column_dictionary")
def columns_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as columns: custom when the size is even, the flag absent for size 1, labelled by type and brand."""
    key = F.col("p_partkey")
    labels = F.array(F.struct(F.concat_ws(" ", "p_type", "p_brand").alias("Label")))
    attributes = record_pages(
        table(spark, sf_dir, "part"), key,
        [
            F.concat_ws("_", "p_name", "p_partkey").alias("LogicalName"),
            F.when(F.col("p_size") != 1, F.col("p_size") % 2 == 0).alias("IsCustomAttribute"),
            F.struct(labels.alias("LocalizedLabels")).alias("DisplayName"),
        ],
    )
    return column_dictionary(attributes)


# Files


@query("csv_roundtrip")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    name = F.when(F.col("p_partkey") % 2 == 1, F.concat("p_name", F.lit(' "x", y\nz'))).otherwise(F.col("p_name"))
    write_csv(table(spark, sf_dir, "part").select("p_partkey", name.alias("p_name")), folder)
    return read_csv(spark, folder)[0]


@query("ragged_quarantine")
def ragged_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 100 suppliers; every fifth row has a cell too few, the next a cell too many."""
    folder = new_folder(spark, "ragged")
    key = F.col("s_suppkey")
    line = F.concat_ws(",", key, F.when(key % 5 != 0, F.col("s_name")), F.when(key % 5 == 1, "more"))
    files = (
        table(spark, sf_dir, "supplier").groupBy(F.floor(key / 100).alias("part"))
        .agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    )
    files.select("part", F.concat(F.lit("s_suppkey,s_name\n"), "lines").alias("value")).write.partitionBy("part").text(folder)
    whole, ragged = read_csv(spark, f"{folder}/part=*")
    good = whole.select(F.concat_ws(",", "s_suppkey", "s_name").alias("raw"), F.lit("loaded").alias("route"))
    return good.unionByName(ragged.select("raw", F.lit("ragged").alias("route")))


@query("csv_split")
def split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large files with quoted line breaks and quotes, read in ranges."""
    folder = new_folder(spark, "split")
    key = F.col("l_orderkey")
    note = F.when(key % 3 == 0, F.concat(F.lit('said "so",\n'), "l_returnflag", F.lit('\n"" ,\n'), F.repeat(F.lit("x\n"), (key % 50).cast("int")))).otherwise(F.concat(F.lit("plain "), key))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", note.alias("note"))
    write_csv(rows, folder)
    return read_csv(spark, folder, split=True)[0]


@query("table_load")
def table_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one table; the second replaces the first, from files with other column orders and a column more."""
    folder = new_folder(spark, "load")
    name = f"loaded_{folder[-32:]}"
    suppliers = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    write_csv(suppliers.select("s_suppkey", F.lit("old").alias("s_name")), f"{folder}/first")
    load_table(spark, f"{folder}/first", name, f"{folder}/table")
    parts = [["s_suppkey", "s_name"], ["s_name", "s_suppkey"], ["s_nationkey", "s_suppkey", "s_name"]]
    for number, columns in enumerate(parts):
        write_csv(suppliers.where(key % 3 == number).select(columns), f"{folder}/second/part={number}")
    return load_table(spark, f"{folder}/second/part=*", name, f"{folder}/table")


@query("file_staging")
def file_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    return read_csv(spark, stage_csv(rows, new_folder(spark, "stage"), "fleet", "lake", "suppliers.csv"))[0]


@query("batch_envelope")
def batch_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 orders per batch; the body is reduced to each part's number and record."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("OE-"), "o_orderkey").alias("id"))
    batches = batch_records(rows_to_records(orders, ["id"]), "o_orderkey", "record", 500)
    parts = F.transform("records", lambda r, i: F.concat(F.lit("Content-ID: "), i, F.lit(CRLF), r))
    return batches.select(
        "batch_id", F.size("records").cast("long").alias("n_records"), F.md5(F.concat_ws(CRLF, parts)).alias("body_md5")
    )


@query("batch_export")
def multipart_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole multipart bodies of 200 customer records each."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("cr_name"),
        F.when(F.col("c_nationkey") != 0, F.col("c_nationkey")).alias("cr_nation"),
    )
    records = rows_to_records(rows, ["cr_name", "cr_nation"])
    bodies = batch_envelopes(records, "c_custkey", "record", "https://tables.example.com/api", "customer", 200)
    return bodies.select("batch_id", "n_records", F.md5("body").alias("body_md5"))

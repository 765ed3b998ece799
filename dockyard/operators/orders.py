"""Order documents: parsing, quarantine, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import received_at_local
from ..schema import (
    CUSTOM_KEYS,
    EMPTY_LINE_ITEMS,
    ITEM_KEYS,
    MALFORMED,
    NULL_OBJECT,
    ORDER_COLUMNS,
    PRICE_KEYS,
    RECEIVED_AT_LOCAL,
    TOP_KEYS,
    VOLUME_KEYS,
)
from ..session import materialise
from .lookup import resolve_codes, resolve_codes_as_of

# Leaves land as text. Objects land as maps so that an absent key and a null value stay apart.
_DOCUMENT = ", ".join(
    [f"{k}: string" for k in TOP_KEYS]
    + ["lineItems: array<string>", "volume: map<string,string>", "customProperties: map<string,string>"]
)
_STRICT = {"allowSingleQuotes": "false"}
_OBJECT = "map<string,string>"
_OBJECTS = ["lineItems", "volume", "customProperties"]


def parse_orders(df: DataFrame, body: str = "body") -> DataFrame:
    """Add the document's ``_cells``, ``n_line_items`` and the quarantine ``reason`` (NULL = good).

    ``_cells`` holds the 24 flat values in column order. The three columns leave through a
    one-element ``inline``: a filter on ``reason`` would otherwise be pushed below the projections
    with every JSON parse copied into it, and it cannot pass a generator.
    """
    text = F.col(body)
    # The JSON reader stops after the first value; inside brackets trailing text breaks the parse.
    documents = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{_DOCUMENT}>>", _STRICT)
    # Keys are listed only for documents that leave something null, to tell null from absent.
    has_null = F.greatest(*[F.col(f"_doc.{k}").isNull() for k in TOP_KEYS + _OBJECTS])
    # Built beside a JSON parse, whose projection Spark compiles in pieces; in a fused stage this many
    # branches make one method too long for the JIT compiler.
    before = F.array(*[_top_value(k) for k in TOP_KEYS[:4]], *[_object_value("_item", k) for k in ITEM_KEYS])
    after = F.array(
        *[_object_value("_doc.volume", k) for k in VOLUME_KEYS],
        *[_object_value("_doc.customProperties", k) for k in CUSTOM_KEYS],
        *[_top_value(k) for k in TOP_KEYS[4:]],
    )
    parsed = (
        df.withColumn("_all", documents)
        .withColumns({
            "_doc": F.get("_all", F.lit(0)),
            "_first": F.get(F.get("_all", F.lit(0))["lineItems"], F.lit(0)),
        })
        .withColumns({
            "_keys": F.when(has_null, F.json_object_keys(text)),
            "_item": F.from_json("_first", _OBJECT, _STRICT),
        })
        .withColumns({
            "_price": F.from_json(F.col("_item")["price"], _OBJECT, _STRICT), "_before": before, "_after": after
        })
    )
    price = F.array(*[_object_value("_price", k) for k in PRICE_KEYS])
    result = F.struct(
        F.concat("_before", price, "_after").alias("_cells"),
        F.size("_doc.lineItems").alias("n_line_items"),
        _reason(text).alias("reason"),
    )
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(result)))


def _top_value(key: str) -> Column:
    """A top-level leaf: absent gives ``''``, null stays null."""
    return F.coalesce(F.col(f"_doc.{key}"), F.when(~_listed(key), ""))


def _object_value(column: str, key: str) -> Column:
    """A leaf of a nested object by the same rule; an absent object gives ``''``."""
    absent = ~F.coalesce(F.map_contains_key(column, F.lit(key)), F.lit(False))
    return F.coalesce(F.col(column)[key], F.when(absent, ""))


def _listed(key: str) -> Column:
    return F.coalesce(F.array_contains("_keys", key), F.lit(False))


def _reason(text: Column) -> Column:
    items = F.col("_doc.lineItems")
    one_object = (F.size("_all") == 1) & F.col("_doc").isNotNull()
    reason = F.when(~F.coalesce(one_object, F.lit(False)), MALFORMED)
    for key in _OBJECTS:
        # Present but not parsed: a JSON null reads as SQL NULL, a value of another type as its text.
        unread = F.col(f"_doc.{key}").isNull() & _listed(key)
        is_null = F.get_json_object(text, f"$.{key}").isNull()
        reason = reason.when(unread & is_null, NULL_OBJECT).when(unread, MALFORMED)
    has_price = F.map_contains_key("_item", F.lit("price"))
    return (
        reason.when(F.size(items) == 0, EMPTY_LINE_ITEMS)
        .when(items.isNotNull() & F.col("_first").isNull(), NULL_OBJECT)
        .when(items.isNotNull() & F.col("_item").isNull(), MALFORMED)
        .when(has_price & F.col("_item")["price"].isNull(), NULL_OBJECT)
        .when(has_price & F.col("_price").isNull(), MALFORMED)
    )


def store_parsed(parsed: DataFrame, path: str, body: str = "body") -> DataFrame:
    """Parsed documents as a table, in place of a cache of them: each flat value by itself, the text of quarantined ones alone.

    The other columns of ``parsed`` are kept, and ``_cells`` and ``reason`` are the same; ``n_line_items`` is left out.
    """
    others = [F.col(f"`{c}`") for c in parsed.columns if c not in (body, "_cells", "n_line_items")]
    values = [F.get("_cells", F.lit(i)).alias(f"_cell{i}") for i in range(len(ORDER_COLUMNS))]
    kept = materialise(parsed.select(*others, F.when(F.col("reason").isNotNull(), F.col(body)).alias(body), *values), path, "zstd")
    cells = F.array(*[F.col(f"_cell{i}") for i in range(len(ORDER_COLUMNS))])
    return kept.select(*others, body, cells.alias("_cells"))


def cell(name: str) -> Column:
    """One flat value of a parsed document."""
    return F.get("_cells", F.lit(ORDER_COLUMNS.index(name)))


def flatten_orders(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 24 flat columns plus the local receipt time; ``keep`` names columns to carry along."""
    stamp = received_at_local(F.col("received_at")).alias(RECEIVED_AT_LOCAL)
    good = parsed.where(F.col("reason").isNull())
    return good.select(*(keep or []), *[cell(c).alias(c) for c in ORDER_COLUMNS], stamp)


LOCATION_CODES = ["homebaseId", "locationId"]


def land_orders(parsed: DataFrame, dictionary: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Flat rows with both location codes resolved; of a code's rows the one with the largest ``pos`` counts, if there is one."""
    return resolve_codes(flatten_orders(parsed, keep), dictionary, LOCATION_CODES, pos=_position(dictionary))


def land_orders_as_of(parsed: DataFrame, versions: DataFrame, keep: list[str]) -> DataFrame:
    """The same with the names that were valid at each order's ``received_at``."""
    return resolve_codes_as_of(flatten_orders(parsed, keep), versions, LOCATION_CODES, "received_at", pos=_position(versions))


def _position(dictionary: DataFrame) -> str | None:
    return "pos" if "pos" in dictionary.columns else None


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())

"""Order, page and metadata documents that Spark derives from the given tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shape import number_rows, record_json
from ..session import spread

# Records of one landed page.
PAGE_SIZE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def location_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of three regions' nations; the other codes have no name."""
    return table(spark, sf_dir, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("v")
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order its lines, in line order, and their number.

    A document holds all lines of its order, so an order's lines meet in one row: a document's natural size.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(line)).alias("lines"), F.count("*").alias("n")
    )


def _item(line: Column) -> Column:
    return F.struct(
        line["l_partkey"].cast("string").alias("id"),
        line["l_quantity"].cast("int").alias("quantity"),
        line["l_returnflag"].alias("quantityUnit"),
        F.struct(
            line["l_extendedprice"].cast("decimal(14,2)").cast("string").alias("amount"),
            F.lit("USD").alias("currency"),
        ).alias("price"),
    )


def _pair(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{key}":'), value)


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order: ``(o_orderkey, received_at, seq, body)``.

    ``lineItems`` is absent for orders without lines and ``volume`` for every seventh order;
    ``CUSTOMER_PO`` is null for even orders; four custom keys are always absent.
    """
    key = F.col("o_orderkey")
    rows = (
        spread(table(spark, sf_dir, "orders"), "o_orderkey")
        .join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(order_lines(spark, sf_dir), F.col("l_orderkey") == key, "left")
    )
    items = F.transform("lines", _item)
    volume = F.struct(
        F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("value"), F.lit("M3").alias("unit")
    )
    custom = record_json([
        F.concat(F.lit("SO"), key).alias("SO_REF"),
        F.col("o_orderstatus").alias("CLASS_CODE"),
        F.when(key % 2 != 0, F.concat(F.lit("PO"), "o_custkey")).alias("CUSTOMER_PO"),
        F.col("c_name").alias("Homebase_Name_info"),
        (key % 10).cast("string").alias("Loading_Sequence"),
    ])
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    pairs = [
        _pair("id", _quoted(F.concat(F.lit("OE-"), key))),
        _pair("type", _quoted(F.col("o_orderstatus"))),
        _pair("sourceOrderId", _quoted(F.col("o_orderpriority"))),
        _pair("teamId", _quoted(F.col("c_mktsegment"))),
        _pair("lineItems", F.to_json(items)),
        _pair("volume", F.when(key % 7 != 0, F.to_json(volume))),
        _pair("customProperties", custom),
        _pair("homebaseId", _quoted(F.col("c_nationkey"))),
        _pair("locationId", _quoted(F.col("o_custkey") % 30)),
        _pair("date", _quoted(day)),
        _pair("orderDate", _quoted(day)),
    ]
    # An absent object has a null pair, which concat_ws leaves out.
    body = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    return rows.select("o_orderkey", F.col("o_orderdate").alias("received_at"), key.alias("seq"), body.alias("body"))


# Hours after its first receipt at which each order is received: at first, again within a day, again after it.
SENT_AT_HOURS = [0, 6, 30]


def sent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's document three times: ``(copy, received_at, seq, body)``."""
    return sendings(order_documents(spark, sf_dir))


def sendings(docs: DataFrame) -> DataFrame:
    """Each of the documents as often as it is sent."""
    copies = F.posexplode(F.array([F.expr(f"INTERVAL '{h}' HOUR") for h in SENT_AT_HOURS])).alias("copy", "delay")
    return docs.select("*", copies).select(
        "copy",
        (F.col("received_at") + F.col("delay")).alias("received_at"),
        (F.col("seq") * len(SENT_AT_HOURS) + F.col("copy")).alias("seq"),
        "body",
    )


def damaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's document, broken in one of seven ways unless its key is a multiple of eight."""
    body, way = F.col("body"), F.col("o_orderkey") % 8

    def replaced(key: str, value: str) -> Column:
        rest = F.regexp_replace(body, rf'"{key}":', f'"was_{key}":')
        return F.concat(F.lit(f'{{"{key}":{value},'), F.substr(rest, F.lit(2)))

    broken = (
        F.when(way == 1, F.concat(body, F.lit(" and more")))
        .when(way == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(way == 3, replaced("lineItems", "[]"))
        .when(way == 4, replaced("lineItems", "null"))
        .when(way == 5, replaced("lineItems", '[{"id":"1","price":null}]'))
        .when(way == 6, replaced("volume", "5"))
        .when(way == 7, replaced("customProperties", "null"))
        .otherwise(body)
    )
    return order_documents(spark, sf_dir).select("o_orderkey", "received_at", "seq", broken.alias("body"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arrivals: the id is the user, blank for every tenth user."""
    blank = F.col("user_id") % 10 == 0
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type",
        F.when(blank, "").otherwise(F.col("user_id").cast("string")).alias("id"),
    )


def record_pages(rows: DataFrame, number: Column, fields: list[Column], linked: bool = True) -> DataFrame:
    """Page documents of ``PAGE_SIZE`` records, grouped by a unique row number."""
    end = ',"@odata.nextLink":"next"}' if linked else "}"
    record = F.struct(number.alias("n"), F.struct(*fields).alias("r"))
    pages = rows.select(F.floor(number / PAGE_SIZE).cast("long").alias("page_no"), record.alias("x")).groupBy(
        "page_no"
    ).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("records"))
    return pages.select(
        "page_no",
        F.lit(200).alias("status"),
        F.concat(F.lit('{"value":'), F.to_json("records"), F.lit(end)).alias("body"),
    )


def _order_fields() -> list[Column]:
    """Numbers, texts, booleans, and values of several kinds; nulls in the one that has any."""
    key = F.col("o_orderkey")
    flag = F.when(key % 5 != 3, key % 2 == 0)
    return [F.lit("W/1").alias("@odata.etag"), key, F.col("o_totalprice").cast("decimal(14,2)").alias("price"), flag.alias("flag"), F.col("o_orderstatus")]


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages, then an empty page, then the same pages again, which must not be read."""
    orders = table(spark, sf_dir, "orders")
    pages = record_pages(orders, F.col("o_orderkey"), _order_fields())
    # The empty page and the stale ones are numbered behind all real ones.
    last = orders.agg((F.floor(F.max("o_orderkey") / PAGE_SIZE) + 1).cast("long").alias("page_no"))
    empty = last.select("page_no", F.lit(200).alias("status"), F.lit('{"value":[],"@odata.nextLink":"next"}').alias("body"))
    stale = pages.select((F.col("page_no") + last.scalar() + 1).alias("page_no"), "status", "body")
    return pages.unionByName(empty).unionByName(stale)


def page_link(number: int | Column) -> Column | str:
    """The address of a page: nothing in it tells the order."""
    if isinstance(number, int):
        return f"https://tables.example.com/api/orders?skip={hashlib.md5(str(number).encode()).hexdigest()}"
    return F.concat(F.lit("https://tables.example.com/api/orders?skip="), F.md5(number.cast("string").cast("binary")))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages ``(link, page_no, status, body)`` landed in the order of their addresses' hashes.

    Each page names the next one and the last one leads back to the first; every page has a copy that nothing leads to.
    """
    orders = table(spark, sf_dir, "orders")
    number = F.floor(F.col("o_orderkey") / PAGE_SIZE).cast("long")
    # Pages are numbered without gaps, whatever keys are missing.
    places = number_rows(orders.select(number.alias("place")).distinct(), "place", "place", start=0).select("place", F.col("_pos").alias("nth"))
    last = places.count() - 1
    pages = record_pages(orders, F.col("o_orderkey"), _order_fields(), linked=False)
    placed = pages.join(places, F.col("page_no") == F.col("place"))
    after = page_link(F.when(F.col("nth") == last, 0).otherwise(F.col("nth") + 1))
    body = F.concat(F.expr("left(body, length(body) - 1)"), F.lit(',"@odata.nextLink":"'), after, F.lit('"}'))
    link = page_link(F.col("nth"))
    linked = placed.select(link.alias("link"), F.xxhash64(link).alias("page_no"), "status", body.alias("body"))
    return linked.unionByName(linked.withColumn("link", F.concat("link", F.lit("&stale"))))

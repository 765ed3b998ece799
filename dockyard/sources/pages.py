"""Paged table and metadata scans over landed page documents ``(page_no, status, body)``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.links import walk
from ..operators.lookup import dict_last_wins
from ..session import materialise, new_folder

NEXT_LINK = "@odata.nextLink"
_PAGE = f"value array<string>, `{NEXT_LINK}` string"
_SYSTEM_PREFIX = "@odata"

_TABLE_RECORD = (
    "value array<struct<LogicalName string, "
    "DisplayName struct<UserLocalizedLabel struct<Label string>>>>"
)
_COLUMN_RECORD = (
    "value array<struct<LogicalName string, IsCustomAttribute boolean, "
    "DisplayName struct<LocalizedLabels array<struct<Label string>>>>>"
)

# Types of values that a typed scan gives as such; values of any other type, and of several, are given as text.
_PLAIN = re.compile(r"^(BIGINT|DOUBLE|BOOLEAN|STRING|DECIMAL\(\d+,\d+\))$")


def read_bodies(pages: DataFrame, *keep: str) -> DataFrame:
    """Each page's body, parsed once and stored: ``keep``, failed, records, next."""
    failed = F.col("status") != 200 if "status" in pages.columns else F.lit(False)
    page = F.from_json("body", _PAGE)
    read = pages.select(*keep, failed.alias("failed"), F.inline(F.array(F.struct(page.alias("page")))))
    read = read.select(*keep, "failed", F.col("page.value").alias("records"), F.col(f"page.`{NEXT_LINK}`").alias("next"))
    return materialise(read, new_folder(pages.sparkSession, "pages"))


def _empty() -> Column:
    return F.coalesce(F.size("records") == 0, F.lit(True))


def _bounds(read: DataFrame) -> Row:
    """Page numbers that decide a scan: the first page, the first one not reached, the first failed one.

    Reading ends before an empty page and after a page without a next link. One aggregate, three numbers, and the keys of the
    first page's first record.
    """
    number = F.col("page_no")
    is_last = F.coalesce("next", F.lit("")) == ""
    end = F.when(F.col("failed"), None).when(_empty(), number).when(is_last, number + 1)
    keys = F.json_object_keys(F.get("records", F.lit(0)))
    return read.agg(
        F.min(number).alias("first"), F.min(end).alias("end"), F.min(F.when(F.col("failed"), number)).alias("failed"),
        F.min_by(F.struct(keys.alias("keys")), number)["keys"].alias("keys"),
    ).first()


def _user_columns(keys: list[str] | None) -> list[str]:
    return [name for name in dict.fromkeys(keys or []) if not name.startswith(_SYSTEM_PREFIX)]


def page_columns(pages: DataFrame, first: int) -> list[str]:
    """Column names: keys of the first record of the first page, system columns left out."""
    keys = F.json_object_keys(F.get(F.from_json("body", _PAGE)["value"], F.lit(0))).alias("keys")
    row = pages.where(F.col("page_no") == first).select(keys).first()
    return _user_columns(row and row["keys"])


def _chosen(names: list[str], column_indexes: list[int] | None) -> list[str]:
    return names if column_indexes is None else [names[i] for i in column_indexes if i < len(names)]


def _table(reached: DataFrame, names: list[str], typed: bool) -> DataFrame:
    """The pages' records as a table of these columns."""
    records = reached.select(F.explode("records").alias("record"))
    if not typed:
        return records.select(F.from_json("record", "map<string,string>").alias("r")).select([F.col("r")[name].alias(name) for name in names])
    # One type per column over all records: a row of type names reaches the driver.
    variants = records.select(F.inline(F.array(F.struct(F.try_parse_json("record").alias("v")))))
    paths = {name: path for name in names if (path := _member(name))}
    found = variants.select([F.schema_of_variant_agg(F.variant_get("v", path, "variant")).alias(name) for name, path in paths.items()]).first() if paths else []
    kinds = dict(zip(paths, found, strict=True))
    return variants.select([_typed(name, paths.get(name), kinds.get(name)).alias(name) for name in names])


def _member(name: str) -> str | None:
    """The path of a key; there is none for a key with both kinds of quotes."""
    if "'" in name and '"' in name:
        return None
    return f'$["{name}"]' if "'" in name else f"$['{name}']"


def _typed(name: str, path: str | None, kind: str | None) -> Column:
    if path is None:
        return F.from_json(F.to_json("v"), "map<string,string>")[name]
    if kind and _PLAIN.match(kind):
        return F.variant_get("v", path, kind.lower())
    return F.variant_get("v", path, "string")


def paged_scan(pages: DataFrame, column_indexes: list[int] | None = None, typed: bool = False) -> DataFrame | None:
    """All records of the reachable pages; None when a reachable page has failed.

    Columns are text, or with ``typed`` the numbers, booleans and texts that all their values are; a column with values of
    several types, or of objects and lists, stays text. Page numbers, the column names of one record and a type per column come
    to the driver, records do not; each body is parsed once. A key missing in a later record gives NULL, an extra key is ignored.
    """
    read = read_bodies(pages, "page_no")
    bounds = _bounds(read)
    end = bounds["end"]
    if bounds["failed"] is not None and (end is None or bounds["failed"] < end):
        return None
    reached = read if end is None else read.where(F.col("page_no") < end)
    return _table(reached, _chosen(_user_columns(bounds["keys"]), column_indexes), typed)


def linked_scan(
    pages: DataFrame, start: str, column_indexes: list[int] | None = None, typed: bool = False
) -> tuple[DataFrame | None, DataFrame]:
    """``(records, notes)`` of pages ``(link, page_no, status, body)`` in the order of their next links, from ``start``.

    Whatever order pages landed in, the links alone tell which come next; of a link landed more than once the page
    with the largest ``page_no`` counts. Reading ends before an empty page, after one without a next link, at a link that
    didn't land, and where a link leads back to a page already read. Records are None when a page that is reached has
    failed. ``notes`` (link, step, note) lists the pages that were not read: ``unreachable``, ``behind the end`` or ``failed``; the page that links back as ``cyclic``;
    and links that lead nowhere as ``missing``. The pages' places come from pointer doubling, so a chain of n pages takes log2(n) rounds.
    """
    spark = pages.sparkSession
    read = read_bodies(pages, "link", "page_no")
    last = F.max_by(F.struct("failed", "records", "next"), "page_no").alias("p")
    nodes = read.groupBy("link").agg(last).select("link", "p.*", F.monotonically_increasing_id().alias("node"))
    nodes = materialise(nodes, new_folder(spark, "linked"))
    target = nodes.select(F.col("link").alias("next"), F.col("node").alias("to"))
    hop = nodes.select("node", "next").where("next <> ''").join(target, "next", "left").select("node", "next", F.col("to"))
    hop = materialise(hop, new_folder(spark, "hops"))
    count = nodes.count()
    first = nodes.where(F.col("link") == start).select("node")
    seen = walk(first, hop.select("node", F.col("to").alias("next")), count)
    steps = materialise(seen.groupBy("node").agg(F.min("step").alias("step")), new_folder(spark, "steps"))
    placed = nodes.join(steps, "node", "left")
    stop = placed.agg(
        F.min(F.when(F.col("failed"), F.col("step"))).alias("failed"), F.min(F.when(~F.col("failed") & _empty(), F.col("step"))).alias("empty"),
        F.min_by(F.struct(F.json_object_keys(F.get("records", F.lit(0))).alias("keys")), "step")["keys"].alias("keys"),
    ).first()
    ends = [s for s in (stop["failed"], stop["empty"]) if s is not None]
    end = min(ends, default=None)
    past = F.col("step") >= end if end is not None else F.lit(False)
    note = (
        F.when(F.col("step").isNull(), "unreachable").when(F.col("failed") & past, "failed").when(past, "behind the end")
    )
    notes = placed.select("link", "step", note.alias("note")).where("note IS NOT NULL")
    read_on = placed.where("step IS NOT NULL").where(~past).select("node", "link", "step")
    onward = hop.join(read_on, "node").join(steps.select(F.col("node").alias("to"), F.col("step").alias("to_step")), "to", "left")
    back = F.when(F.col("to").isNull(), "missing").when(F.col("to_step") <= F.col("step"), "cyclic")
    lost = onward.select(F.when(F.col("to").isNull(), F.col("next")).otherwise(F.col("link")).alias("link"), "step", back.alias("note")).where("note IS NOT NULL")
    notes = notes.unionByName(lost)
    if stop["failed"] is not None and (stop["empty"] is None or stop["failed"] < stop["empty"]):
        return None, notes
    names = _chosen(_user_columns(stop["keys"]), column_indexes)
    reached = placed.where("step IS NOT NULL").where(~past)
    return _table(reached, names, typed), notes


def union_pages(parts: list[DataFrame]) -> DataFrame:
    """Bag union under the first part's columns; a column missing in a later part gives NULL."""
    first, *rest = parts
    out = first
    for part in rest:
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema if f.name not in part.columns]
        out = out.unionByName(part.select([c for c in first.columns if c in part.columns] + missing))
    return out


def table_dictionary(docs: DataFrame) -> DataFrame:
    """Display label -> logical name of tables. Unlabelled tables are skipped, the last label wins."""
    entries = docs.select(
        "page_no", F.posexplode(F.from_json("body", _TABLE_RECORD)["value"]).alias("pos", "r")
    ).select(
        F.col("r.DisplayName.UserLocalizedLabel.Label").alias("display"),
        F.coalesce("r.LogicalName", F.lit("")).alias("logical"),
        F.struct("page_no", "pos").alias("_pos"),
    )
    return dict_last_wins(entries.where("display <> ''"), "display", "logical", "_pos")


def column_dictionary(docs: DataFrame) -> DataFrame:
    """Display label -> logical name of user-defined columns; the last label wins."""
    entries = (
        docs.select(
            "page_no", F.posexplode(F.from_json("body", _COLUMN_RECORD)["value"]).alias("pos", "r")
        )
        .where("r.IsCustomAttribute")
        .select(
            F.get("r.DisplayName.LocalizedLabels", F.lit(0))["Label"].alias("display"),
            F.col("r.LogicalName").alias("logical"),
            F.struct("page_no", "pos").alias("_pos"),
        )
    )
    return dict_last_wins(entries.where("display <> ''"), "display", "logical", "_pos")


def mapping_of(dictionary: DataFrame, names: list[str]) -> dict[str, str]:
    """The entries for ``names`` (column names of one table) as a driver-side mapping."""
    rows = dictionary.where(F.col("display").isin(names)).collect()
    return {r["display"]: r["logical"] for r in rows}


def probe_table(spark: SparkSession, table: str, rows: int = 20) -> DataFrame | None:
    """A preview of ``table``, or None when there is no such table."""
    return spark.table(table).limit(rows) if spark.catalog.tableExists(table) else None

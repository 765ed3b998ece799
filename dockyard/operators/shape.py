"""Column and row shape: projections, renames, records, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean_cell, is_date_name
from ..session import materialise, new_folder


def _by_position(df: DataFrame, picks: list[tuple[int, str]]) -> DataFrame:
    """Select columns by index under new names; unlike a name, an index is never ambiguous."""
    slots = [f"_slot{i}" for i in range(len(df.columns))]
    return df.toDF(*slots).select([F.col(slots[i]).alias(name) for i, name in picks])


def project_by_name(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns in requested order. Exact case; unknown names are skipped, a repeated header's first column is taken."""
    names = df.columns
    return _by_position(df, [(names.index(w), w) for w in wanted if w in names])


def project_by_position(df: DataFrame, indexes: list[int]) -> DataFrame:
    """Columns by index; too large ones are skipped, negative ones count from the end."""
    names = df.columns
    kept = [range(len(names))[i] for i in indexes if i < len(names)]
    return _by_position(df, [(i, names[i]) for i in kept])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Exact-case rename, unmapped names kept. Of columns that end up with one name the last is kept."""
    last: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        last[mapping.get(name, name)] = i
    return _by_position(df, [(i, name) for name, i in last.items()])


def keep_mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Only the columns that have a logical name, under that name."""
    kept = {h: name for h, name in mapping.items() if name}
    return rename_columns(project_by_name(df, [c for c in dict.fromkeys(df.columns) if c in kept]), kept)


def record_json(columns: list[str | Column]) -> Column:
    """One JSON object per row; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def rows_to_records(df: DataFrame, columns: list[str] | None = None, name: str = "record") -> DataFrame:
    """Rows as JSON records of ``columns`` (default: all); other columns are kept beside them."""
    columns = columns or df.columns
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, record_json(columns).alias(name))


def clean_payload(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Mapped columns under their logical names with every cell cleaned (variants)."""
    named = keep_mapped(df, mapping)
    return named.select([clean_cell(F.col(f"`{c}`"), is_date_name(c)).alias(c) for c in named.columns])


# Most rows that are kept as one sorted heap per task; more are numbered in ranges first. Both give the same rows in order.
TOP_K_BOUND = 100_000


def limit_rows(df: DataFrame, limit: int, pos: str) -> DataFrame:
    """The first rows by ``pos``. ``limit`` counts the header row, so n gives n - 1 rows; 0 gives all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit == 0:
        return df
    if limit - 1 <= TOP_K_BOUND:
        return df.orderBy(pos).limit(limit - 1)
    return number_rows(df, pos, name="_row").where(F.col("_row") < limit - 1).orderBy("_row").drop("_row")


def number_rows(df: DataFrame, *order: str, name: str = "_pos", start: int = 0) -> DataFrame:
    """Exact consecutive row numbers in the given order, which should leave no ties.

    Ranges are sorted side by side and stored; only the size of each range comes to the driver, so no
    window runs over all rows.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(ranges.withColumn("_at", F.monotonically_increasing_id()), new_folder(spark, "numbered"))
    # The id holds the range in its upper bits and the row within the range in its lower 33.
    range_no = F.shiftright("_at", 33)
    sizes = stored.groupBy(range_no.alias("_range")).agg(F.count("*").alias("n")).orderBy("_range").collect()
    offsets, total = [], start
    for row in sizes:
        offsets.append((row["_range"], total))
        total += row["n"]
    firsts = spark.createDataFrame(offsets, "_range long, _first long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored.withColumn("_range", range_no).join(firsts, "_range")
    return numbered.withColumn(name, F.col("_first") + within).drop("_range", "_first", "_at")

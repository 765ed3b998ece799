"""Text tables: CSV files with a header row, and rectangle slices of them."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, new_folder
from .quoted import csv_records, state_after

_BAD_ROW = "_bad_row"

# Where a row stands in its input: file, split of the file, row in the split.
INPUT_POSITION = ["file", "block", "row"]


def input_position() -> Column:
    """An orderable position of each row of a file scan."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _csv(spark: SparkSession, multi_line: bool):
    return spark.read.option("multiLine", multi_line).option("escape", '"')


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file's first record that isn't empty, and how many lines stand before it; what follows it is not read."""
    held: list[str] = []
    inside, skipped = False, 0
    for batch in batches:
        for file, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
            line = line.removesuffix("\r")
            if not held and not line.strip("\ufeff"):
                skipped += 1
                continue
            held.append(line)
            inside = state_after(line, inside)
            if not inside:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array(["\n".join(held)]), pa.array([skipped], pa.int64())], names=["file", "header", "skipped"])
                return


# Larger than any file: each file is one partition of the header scan.
_WHOLE = str(1 << 50)


def file_headers(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, header, skipped): the header text of each file and the empty lines before it; None when the path is missing. Of each file only the beginning is read."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, _WHOLE)
        lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
        return materialise(lines.mapInArrow(_first_records, "file string, header string, skipped long"), new_folder(spark, "headers"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _names(header: str) -> tuple[str, ...]:
    """Header names with repeated ones numbered (``a``, ``a__2``)."""
    seen: dict[str, int] = {}
    names = []
    for name in next(csv.reader(io.StringIO(header.removeprefix("\ufeff"), newline="")), []):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}__{seen[name]}")
    return tuple(names)


# Most different header texts of one read; more is a sign of files that are no table.
MOST_HEADERS = 1_000


def _groups(heads: DataFrame) -> list[tuple[tuple[str, ...], list[str]]]:
    """Different headers by their first file: (names, header texts)."""
    found = heads.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").limit(MOST_HEADERS + 1).collect()
    if len(found) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in found:
        groups.setdefault(_names(row["header"]), []).append(row["header"])
    return list(groups.items())


def _glob_safe(file: str) -> str:
    """A listed file's address as a path to read: percent signs resolved, signs of patterns escaped."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", unquote(file))


def read_csv(
    spark: SparkSession, path: str, multi_line: bool = True, with_position: bool = False, split: bool = False
) -> tuple[DataFrame, DataFrame] | None:
    """``(rows, ragged)``: every cell is text, an empty cell is ``''``.

    Each file is read by its own header: cells go to the columns of their names, in the order of the first file's
    header, and columns that only other files have follow; a column that a file lacks is ``''`` there. ``ragged`` holds the source text
    (``raw``) and cells of rows whose cell count differs from their file's header. A missing path gives None.

    Quoted line breaks need ``multi_line``, which reads each file in one task, or ``split``, which reads ranges of
    large files in many tasks; pass ``multi_line=False`` for files without such cells.
    """
    heads = file_headers(spark, path)
    if heads is None:
        return None
    groups = _groups(heads)
    columns = list(dict.fromkeys(name for names, _ in groups for name in names))
    whole, ragged = [], []
    for names, headers in groups:
        if split:
            scan = _split_scan(spark, path, heads.where(F.col("header").isin(headers)), len(groups) > 1, len(names))
        else:
            files: str | list[str] = path
            if len(groups) > 1:
                files = [_glob_safe(r["file"]) for r in heads.where(F.col("header").isin(headers)).select("file").collect()]
            scan = _line_scan(spark, files, len(names), multi_line)
        place = {name: f"c{i}" for i, name in enumerate(names)}
        cells = [(F.coalesce(place[n], F.lit("")) if n in place else F.lit("")).alias(n) for n in columns]
        position = [_POSITION[split]().alias("_pos")] if with_position else []
        # Spark refuses a scan of the bad-row column alone (a bare count), so the filter reads a cell too.
        is_whole = F.col(_BAD_ROW).isNull() & (F.length(F.coalesce("c0", F.lit(""))) >= 0)
        whole.append(scan.where(is_whole).select(*cells, *position))
        ragged.append(scan.where(~is_whole).select(F.col(_BAD_ROW).alias("raw"), *cells))
    if not groups:
        none = spark.createDataFrame([], "raw string")
        return none.select(), none
    return reduce(DataFrame.unionByName, whole), reduce(DataFrame.unionByName, ragged)


def _slots(width: int) -> str:
    return ", ".join(f"{slot} string" for slot in [*[f"c{i}" for i in range(width)], _BAD_ROW])


def _line_scan(spark: SparkSession, files: str | list[str], width: int, multi_line: bool) -> DataFrame:
    # The schema is laid over the cells by position, so header names are not compared with it.
    return (
        _csv(spark, multi_line)
        .option("header", True)
        .option("enforceSchema", True)
        .option("columnNameOfCorruptRecord", _BAD_ROW)
        .schema(_slots(width))
        .csv(files)
    )


def _split_scan(spark: SparkSession, path: str, heads: DataFrame, some: bool, width: int) -> DataFrame:
    """The same columns by ranges; ``heads`` names the files, ``some`` says that they are not all."""
    records = csv_records(spark, path)
    if some:
        records = records.join(heads.select("file"), "file", "left_semi")
    # The header is the first record behind the empty lines that some files begin with.
    late = heads.where("skipped > 0").select("file", "skipped")
    records = records.withColumn("skipped", F.lit(0)) if late.isEmpty() else records.join(late, "file", "left")
    rows = records.where((F.col("block") > 0) | (F.col("number") > F.coalesce("skipped", F.lit(0)))).where("text <> ''")
    options = {"escape": '"', "columnNameOfCorruptRecord": _BAD_ROW, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    return rows.select("file", "block", "number", F.from_csv("text", _slots(width), options).alias("_c")).select("file", "block", "number", "_c.*")


def _record_position() -> Column:
    return F.struct("file", "block", F.col("number").alias("row"))


_POSITION = {False: input_position, True: _record_position}


def _column_number(letters: str) -> int:
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter) - ord("A") + 1
    return number


_CORNERS = re.compile(r"^([A-Z]*)([0-9]*)(?::([A-Z]*)([0-9]*))?$")


def range_slice(df: DataFrame, a1: str | None = None, pos: str = "_pos") -> DataFrame:
    """Rows and columns of an A1 rectangle such as ``A2:C40``, ``A2:C`` or ``B:D``.

    ``pos`` holds the sheet row; row 1 is the header, so data start at 2. This is a pushed-down
    filter and a projection; nothing is sorted.
    """
    columns = [c for c in df.columns if c != pos]
    if a1 is None:
        return df.select(columns)
    match = _CORNERS.match(a1)
    if not match or not a1:
        raise ValueError(f"not a cell range: {a1}")
    left, top, right, bottom = match.groups()
    if right is None and bottom is None:
        right, bottom = left, top
    first = _column_number(left) - 1 if left else 0
    last = _column_number(right) if right else len(columns)
    out = df
    if top:
        out = out.where(F.col(pos) >= int(top))
    if bottom:
        out = out.where(F.col(pos) <= int(bottom))
    return out.select(columns[first:last])

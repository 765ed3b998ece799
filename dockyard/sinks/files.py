"""CSV files, lake tables and staged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_csv


def write_csv(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Overwrite ``path`` with CSV that a quote-doubling reader understands.

    A quoted line break makes a file unsplittable for its readers, so ``rows_per_file`` can bound
    the files. Lines end in ``\\n``: another line end would also change breaks inside cells.
    """
    options = {
        "header": True,
        "escape": '"',
        "emptyValue": "",
        # The writer strips cells unless told not to.
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "maxRecordsPerFile": rows_per_file,
    }
    df.write.mode("overwrite").options(**options).csv(path)


def load_table(
    spark: SparkSession, files: str, table: str, location: str | None = None, multi_line: bool = True
) -> DataFrame | None:
    """Replace ``table`` by the rows of CSV ``files``; a blank name or missing files do nothing.

    Rows whose cell count differs from the header's replace ``{table}_ragged``, source text included, so none is lost.
    """
    if not table:
        return None
    scan = read_csv(spark, files, multi_line)
    if scan is None:
        return None
    writer = scan[0].write.mode("overwrite").format("parquet")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(table)
    beside = scan[1].write.mode("overwrite").format("parquet")
    if location:
        beside = beside.option("path", f"{location.rstrip('/')}_ragged")
    beside.saveAsTable(f"{table}_ragged")
    return spark.table(table)


def staged_path(root: str, workspace: str, lakehouse: str, source: str, name: str | None = None) -> str:
    """Where a staged file lives; the loader reads the same path, so both use this helper."""
    return f"{root}/{workspace}/{lakehouse}.Lakehouse/Files/output/{name or source.rstrip('/').split('/')[-1]}"


def stage_csv(df: DataFrame, root: str, workspace: str, lakehouse: str, name: str) -> str:
    """Write ``df`` as CSV to its staged path, replacing what is there."""
    path = staged_path(root, workspace, lakehouse, name)
    write_csv(df, path)
    return path

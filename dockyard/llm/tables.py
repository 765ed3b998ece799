"""Input tables, folds and work tables the operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.session import materialise, new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the folder all executors share and read back: later steps cost a read, not a rerun."""
    return materialise(df, new_folder(df.sparkSession, name), compression)


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id falls in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    held = {c.lower() for c in df.columns}
    while stem.lower() in held:
        stem += "_"
    return stem


def vocabulary(spark: SparkSession, path: str):
    """A tokenizer's file, read once by the driver and broadcast (one or two MB, whatever the input is)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are: DOCKYARD_TOKENIZERS, or the installed package's folder."""
    folder = os.environ.get("DOCKYARD_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)

"""Dictionary building and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_join


def dict_last_wins(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """One row per key with the value at the highest position. Combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, pos).alias(value))


def first_match_wins(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """One row per key with the value at the lowest position."""
    return df.groupBy(key).agg(F.min_by(value, pos).alias(value))


def resolve_codes(
    df: DataFrame, dictionary: DataFrame, columns: list[str], key: str = "k", value: str = "v", pos: str | None = None
) -> DataFrame:
    """Replace each code column by the dictionary's name for it; an unknown code becomes ``''``.

    Of a key's rows the one with the largest ``pos`` counts, so no row of ``df`` is multiplied; without ``pos`` a key with two
    different names is an error, since a table's rows have no order of their own. A hit with
    a null name stays null. No broadcast is forced: Catalyst (by size) and AQE (by measured size) pick it, and a dictionary beyond the
    threshold falls back to a skew-split sort-merge join.
    """
    side = one_name(dictionary, [key], value, pos)
    out = df
    for i, column in enumerate(columns):
        k, v = f"_key{i}", f"_name{i}"
        names = side.select(F.col(key).alias(k), F.col(value).alias(v))
        out = _named(out.join(names, F.col(column) == F.col(k), "left"), column, k, v)
    return out


def one_name(dictionary: DataFrame, keys: list[str], value: str, pos: str | None) -> DataFrame:
    """``(keys, value)`` with one row per key. Combines before the shuffle."""
    if pos is not None:
        # Wrapped, so that a null name counts where the last row has one.
        last = F.max_by(F.struct(F.col(value)), F.col(pos))[value]
        return dictionary.groupBy(*keys).agg(last.alias(value))
    low, high = F.min(F.struct(F.col(value))), F.max(F.struct(F.col(value)))
    clash = F.concat(F.lit("no position tells which name counts for code "), F.col(keys[-1]).cast("string"))
    sides = dictionary.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"))
    return sides.select(*keys, F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")[value]).otherwise(F.raise_error(clash)).alias(value))


def _named(joined: DataFrame, column: str, k: str, v: str) -> DataFrame:
    return joined.withColumn(column, F.when(F.col(k).isNull(), "").otherwise(F.col(v))).drop(k, v)


def resolve_codes_as_of(
    df: DataFrame, versions: DataFrame, columns: list[str], at: str, key: str = "k", value: str = "v", pos: str | None = None
) -> DataFrame:
    """The same by the dictionary that was valid at each row's time ``at``.

    ``versions`` (valid_from, key, value) holds whole dictionaries, each valid until the next one; before the first one
    every code is unknown. An as-of join finds the version of each time that occurs, which is looked up like a code; code and
    version together give the name. So the sorted ranges of the as-of join hold times alone, not the rows.
    """
    starts = versions.select("valid_from").distinct().select("valid_from", F.col("valid_from").alias("_version"), F.lit(0).alias("_all"))
    times = df.select(F.col(at).alias("_at")).distinct().withColumn("_all", F.lit(0))
    found = asof_join(times, starts, "_all", "_at", "valid_from", ["_version"]).drop("_all")
    dated = df.join(found, F.col(at) == F.col("_at"), "left").drop("_at")
    side = one_name(versions, ["valid_from", key], value, pos)
    for i, column in enumerate(columns):
        k, v, since = f"_key{i}", f"_name{i}", f"_since{i}"
        names = side.select(F.col(key).alias(k), F.col(value).alias(v), F.col("valid_from").alias(since))
        dated = _named(dated.join(names, (F.col(column) == F.col(k)) & (F.col("_version") == F.col(since)), "left"), column, k, v).drop(since)
    return dated.drop("_version")


def unseen(incoming: DataFrame, ledger: DataFrame, key: str, now) -> DataFrame:
    """Incoming rows whose key has no live entry in ``ledger(key, expires_at)`` at ``now``."""
    live = ledger.where(F.col("expires_at").isNull() | (now < F.col("expires_at"))).select(key)
    return incoming.join(live, key, "left_anti")

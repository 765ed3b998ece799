"""Streaming order intake.

Each micro-batch runs the same transforms as a batch job. What is remembered between batches is one
ledger row per accepted id, in a table bucketed by id: a batch reads the ledger of earlier
batches only and writes its own folder of every table, so a batch that is run again after a lost
driver or executor replaces its own output and decides the same. A manifest names the folders that are whole
and is written last; readers take no others. What a sink fails to write is kept, and written at the next start or before the next batch,
whichever comes first. Hot ids inside a micro-batch take the same chunk walks as in a batch job, which a per-key state
function could not split.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import ONE_DAY
from ..operators.orders import cell, land_orders, land_orders_as_of, parse_orders, quarantined, store_parsed
from ..operators.outcomes import error_log, outcome_rows
from ..operators.ttl import classify_arrivals, ledger_entries
from ..schema import MSG_DUPLICATE_LOG
from ..session import materialise, shuffles_dropped, spread
from ..sinks.records import record_rows, write_batch
from .commits import pending, record_commit
from .ledger import FEW_ROWS, Ledger

SCRIPT = "intake"

Sink = Callable[[DataFrame, str, int], None]


def decide_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    key: str,
    ts: str,
    seq: str,
    ttl: timedelta = ONE_DAY,
    **options,
) -> DataFrame:
    """Verdicts ``(key, ts, seq, accepted)`` of one micro-batch; writes them and their ledger rows.

    A batch reads the ledger rows that end after its first arrival; arrivals may land out of order by any time.
    """
    spark = batch.sparkSession
    ledger = Ledger(spark, root, batch.schema[key].dataType, batch.schema[ts].dataType)
    live = None
    if batch_id:
        size = batch.agg(F.min(ts).alias("oldest"), F.count("*").alias("n")).first()
        if size["oldest"] is not None:
            ids = [r[0] for r in batch.select(key).distinct().collect()] if size["n"] <= FEW_ROWS else None
            live = ledger.live(batch_id, size["oldest"], ids)
    verdicts = classify_arrivals(batch, key, ts, seq, ttl, live, work=f"{root}/work", **options)
    verdicts = materialise(verdicts, f"{root}/verdicts/batch_id={batch_id}")
    ledger.append(ledger_entries(verdicts.where("accepted"), key, ts, ttl), batch_id)
    return verdicts


def hold_pending(rows: DataFrame, root: str, name: str, batch_id: int) -> None:
    """Keep the rows of a failed sink until the next start, or a later batch, has written them."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/pending/{name}/batch_id={batch_id}")


def drain_pending(spark: SparkSession, root: str, name: str, sink: Sink, waiting: set[int]) -> None:
    """Write what ``sink`` failed to write in the batches ``waiting``, which leave the set as they are done. A sink's folders
    are replaced whole, so that a repeat changes nothing; a batch that fails again keeps waiting."""
    for batch_id in sorted(waiting):
        sink(spark.read.parquet(f"{root}/pending/{name}/batch_id={batch_id}"), f"{root}/{name}", batch_id)
        record_commit(spark, root, batch_id, [name])
        waiting.discard(batch_id)


def start_dedup(
    arrivals: DataFrame,
    root: str,
    key: str,
    ts: str,
    seq: str,
    ttl: timedelta = ONE_DAY,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Decide a stream of arrivals; verdicts land in ``{root}/verdicts``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        decide_batch(batch, batch_id, root, key, ts, seq, ttl, **options)

    return _start(arrivals, root, process, trigger)


def start_intake(
    orders: DataFrame,
    root: str,
    dictionary: Callable[[], DataFrame] | None,
    mapping: Callable[[], dict[str, str]],
    ttl: timedelta = ONE_DAY,
    append_sink: Sink | None = None,
    record_sink: Sink | None = None,
    trigger: dict | None = None,
    versions: Callable[[], DataFrame] | None = None,
    **options,
) -> StreamingQuery:
    """Land a stream of order documents ``(received_at, seq, body)`` below ``root``.

    ``dictionary`` and ``mapping`` are read anew for each micro-batch, so refreshed side data apply
    from the next batch on. Each sink gets ``(rows, folder, batch_id)`` and may fail by itself: the
    failure is logged and the other tables are still written. A failed record sink answers 500.
    ``trigger`` takes what ``DataStreamWriter.trigger`` takes; by default all landed files are
    processed and the query ends. Rows that a sink failed to write are kept and written at the next start, also if nothing
    new has landed, or before the next batch, so that no accepted order is lost. ``versions`` (valid_from, k, v) gives the dictionary's
    states in place of ``dictionary``: each order then takes the names of its receipt time, however late it lands.
    """
    spark = orders.sparkSession
    sinks = {"orders": append_sink or write_batch, "records": record_sink or write_batch}
    # Listed once a start; from then on known.
    waiting = {name: pending(spark, root, name) for name in sinks}
    for name, sink in sinks.items():
        # A sink that still fails is asked, and logged, again with the next batch.
        with suppress(Exception):
            drain_pending(spark, root, name, sink, waiting[name])

    def process(batch: DataFrame, batch_id: int) -> None:
        with shuffles_dropped(batch.sparkSession):
            land(batch, batch_id)

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A table, not a cache: a batch may be larger than the executors' memory, and a table is a tenth of the cache's size.
        parsed = store_parsed(parse_orders(spread(batch, "seq")), f"{root}/work/parsed")
        good = parsed.where(F.col("reason").isNull()).select(cell("id").alias("id"), "received_at", "seq")
        verdicts = decide_batch(good, batch_id, root, "id", "received_at", "seq", ttl, **options)
        # Stored by itself: planned by its real size, the anti-join leaves the wide rows where they are.
        rejected = materialise(verdicts.where(~F.col("accepted")), f"{root}/refused/batch_id={batch_id}")
        failures = []

        def attempt(work: Callable[[], None], name: str) -> bool:
            try:
                work()
                return True
            except Exception as error:  # a sink's failure must not stop the others
                failures.append((f"failed to write {name}", str(error)))
                return False

        def written(name: str, rows: DataFrame) -> bool:
            attempt(lambda: drain_pending(spark, root, name, sinks[name], waiting[name]), name)
            done = attempt(lambda: sinks[name](rows, f"{root}/{name}", batch_id), name)
            if not done:
                hold_pending(rows, root, name, batch_id)
                waiting[name].add(batch_id)
            return done

        keep = ["received_at", "seq"]
        landed = land_orders(parsed, dictionary(), keep) if versions is None else land_orders_as_of(parsed, versions(), keep)
        flat = landed.join(rejected.select("seq"), "seq", "left_anti")
        whole = ["orders"] * written("orders", flat)
        if whole and not append_sink:
            # Looked up and joined once: the records are the same rows under other names.
            flat = spark.read.schema(flat.schema).parquet(f"{root}/orders/batch_id={batch_id}")
        recorded = written("records", record_rows(flat, mapping()))
        whole += ["records"] * recorded

        bad = quarantined(parsed).select("received_at", "seq", "body", "reason")
        write_batch(bad, f"{root}/quarantine", batch_id)
        answers = outcome_rows(verdicts, keep=["seq"], sink_failed=F.lit(not recorded) & F.col("accepted"))
        write_batch(answers, f"{root}/outcomes", batch_id)
        # Logging never stops a batch.
        if attempt(lambda: write_batch(_log_rows(spark, parsed, rejected, batch, failures), f"{root}/error_log", batch_id), "log"):
            whole.append("error_log")
        record_commit(spark, root, batch_id, [*whole, "quarantine", "outcomes", "verdicts"])

    return _start(orders, root, process, trigger)


def _log_rows(
    spark: SparkSession, parsed: DataFrame, rejected: DataFrame, batch: DataFrame, failures: list[tuple[str, str]]
) -> DataFrame:
    duplicates = error_log(
        rejected, SCRIPT, F.col("received_at"), F.concat(F.lit("Duplicated OE "), "id"), F.lit(MSG_DUPLICATE_LOG)
    )
    refused = error_log(
        quarantined(parsed), SCRIPT, F.col("received_at"), F.lit("failed to read order document"), F.col("reason")
    )
    rows = duplicates.unionByName(refused)
    if failures:
        # At most one row per sink, stamped with the batch's last arrival.
        failed = spark.createDataFrame(failures, "description string, message string")
        at = batch.agg(F.max("received_at")).scalar()
        rows = rows.unionByName(error_log(failed, SCRIPT, at, F.col("description"), F.col("message")))
    return rows


def _start(
    stream: DataFrame, root: str, process: Callable[[DataFrame, int], None], trigger: dict | None
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

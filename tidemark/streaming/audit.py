"""The audit log as an append-only stream sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.sources.files import exists
from tidemark.sources.scratch import materialize

DAY = "log_day"
NO_DAY = "none"


def _append(batch: DataFrame, path: str, identity: list[str], time_column: str) -> None:
    """Append the rows of `batch` whose identity the log at `path` does not hold."""
    day = F.coalesce(F.date_format(time_column, "yyyy-MM-dd"), F.lit(NO_DAY))
    new = materialize(batch.dropDuplicates(identity).withColumn(DAY, day), "audit")
    if exists(batch.sparkSession, path):
        # The day is the log's partition, so only the days of the batch are read.
        same = F.col(f"held.{DAY}") == F.col(f"new.{DAY}")
        for name in identity:
            same = same & F.col(f"held.{name}").eqNullSafe(F.col(f"new.{name}"))
        log = batch.sparkSession.read.schema(new.schema).parquet(path).select(*identity, DAY)
        held = log.alias("held").join(new.select(*identity, DAY).alias("new"), same, "left_semi")
        new = new.alias("new").join(held.alias("held"), same, "left_anti")
    new.write.partitionBy(DAY).mode("append").parquet(path)


def stream_audit(
    events: DataFrame,
    path: str,
    checkpoint_path: str,
    key: list[str],
    time_column: str = "when",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append events to `path`, one folder `log_day=<day>` per day.

    An event is known by `key` and its time: a repeat is dropped, however late it
    comes, and an event the log does not hold is kept, however late it comes. A
    micro-batch that runs again, or a stream that starts over, adds nothing twice.
    Events without a time go to the day `none`.
    """
    identity = list(dict.fromkeys([*key, time_column]))
    return (
        events.writeStream.foreachBatch(lambda batch, _: _append(batch, path, identity, time_column))
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

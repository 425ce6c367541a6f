"""Streams that stop and go on: each key once, running counts, progress in a checkpoint, batches written again instead of twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import aggregates as agg


def run_once(spark: SparkSession, path: str, schema, key: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, delay: str = "1 day", time_column: str | None = None) -> StreamingQuery:
    """Processes what is new in ``path`` and writes it to ``out``, then stops.

    Each batch has a folder of its own name, which a replayed batch overwrites, so a failure between
    writing and the checkpoint repeats no row.  With a time column, keys are remembered for ``delay`` (watermark);
    without one, the state grows with the number of keys.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    rows = rows.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([key]) if time_column else rows.dropDuplicates([key])
    return write_batches(rows, out, checkpoint, "append", process=process)


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str, written: Callable[[int], None] | None = None, process: Callable[[DataFrame], DataFrame] = lambda b: b) -> StreamingQuery:
    """Writes what is new to ``out``, a folder ``batch=<number>`` for each batch, then stops.

    A batch that was written but not committed to the checkpoint is computed again with the same number and
    overwrites its folder.  ``written`` is called after each batch's write, before its commit.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if written:
            written(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def pending(rows: DataFrame, done: DataFrame, key: str, seq: str, time: str, delay: str) -> DataFrame:
    """Streamed rows whose key is not in the finished table ``done``: the first by ``seq`` of each key in the batch where it first comes.

    The state holds one flag a key, and a timer drops it when the watermark (the latest time less ``delay``) has passed the
    key's last row: state is bounded by the keys of that span, and a key that comes back later counts as new.  Rows of one key
    are reduced to one for each Arrow batch before the shuffle, so a key that holds a third of all rows sends few of them.
    Rows without a time keep their key for good; rows without a key are one key, and never finished; rows older than the watermark are dropped.
    """
    last, millis, endless = "_last", "_millis", "_endless"
    timed = rows.withColumns({last: F.col(time).cast("timestamp"), endless: F.col(time).isNull()})
    names, columns = rows.columns, timed.columns

    def first_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pdf.sort_values(seq, kind="stable").groupby(key, dropna=False, sort=False)
        return groups.head(1).assign(**{c: groups[c].transform("max") for c in (last, endless)})[columns]

    def first_row(pdf: pd.DataFrame) -> pd.DataFrame:
        # Called for each key: grouping a frame would cost milliseconds.
        return pdf if len(pdf) == 1 else pdf.iloc[pdf[seq].array.argsort(kind="stable", na_position="last")[:1]]

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield first_rows(pdf)

    def first_time(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        (until,) = state.get if state.exists else (0,)
        for pdf in batches:
            if not state.exists:
                best = first_row(pdf if best is None else pd.concat([best, pdf]))
            until = -1 if until < 0 or pdf[endless].to_numpy().any() else max(until, int(pdf[millis].to_numpy().max()))
        if not state.exists:
            yield best[names]
        state.update((until,))
        if until >= 0:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs()) + 1)

    left = timed.join(done.select(key).distinct(), key, "left_anti").select(columns)
    first = left.mapInPandas(reduced, timed.schema).withColumn(millis, F.unix_millis(last)).withWatermark(last, delay)
    return first.groupBy(key).applyInPandasWithState(first_time, rows.schema, "until long", "update", GroupStateTimeout.EventTimeTimeout)


def running_wins(judgments: DataFrame, baseline: str) -> DataFrame:
    """Wins, losses, ties, total and rate so far of each arm that a batch changes, for a stream in update mode; the state is one row an arm."""
    return agg.win_rates(judgments, baseline)


def latest(progress: DataFrame, key: str) -> DataFrame:
    """The last row of each key among the batches that ``write_batches`` wrote."""
    rest = [c for c in progress.columns if c not in {key, "batch"}]
    return progress.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")


def running_counts(rows: DataFrame, by: str) -> DataFrame:
    """Counts so far; for a stream in complete mode."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))

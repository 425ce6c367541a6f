"""Streams that are stopped and restarted inside the query: what they give must equal the answer over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..streaming import resume
from .derived import cte, judgments, table
from .registry import query

STOP = "stopped between the write and the commit"


def _stop(number: int) -> None:
    raise RuntimeError(f"{STOP} of batch {number}")


def _runs(rows: DataFrame, seq: str, mode: str, stream: Callable[[DataFrame], DataFrame], again: bool) -> list[DataFrame]:
    """What two runs wrote, over the first half of ``seq`` and then the second; with ``again``, the source delivers the first half once more.

    The second run fails after its first write, before the commit, so that batch is replayed.
    """
    spark = rows.sparkSession
    src, out, mark = (scratch.path(spark, f"stream-{x}") for x in ("rows", "out", "mark"))
    read = lambda: stream(spark.readStream.schema(rows.schema).parquet(src))
    middle = rows.agg(F.expr(f"(min({seq}) + max({seq})) div 2")).first()[0]
    early = F.lit(False) if middle is None else F.col(seq) <= middle
    rows.where(early).write.parquet(src)
    resume.write_batches(read(), out, mark, mode)
    first = scratch.stored(spark.read.parquet(out), "stream-first")
    (rows if again else rows.where(~early)).write.mode("append").parquet(src)
    try:
        resume.write_batches(read(), out, mark, mode, _stop)
    except StreamingQueryException as e:
        if STOP not in str(e):
            raise
    resume.write_batches(read(), out, mark, mode)
    return [first, spark.read.parquet(out)]


@query("""WITH k AS (SELECT event_id, coalesce(user_id::VARCHAR, '') || '|' || coalesce(event_type, '') AS key, value FROM events)
  SELECT min(event_id) AS seq, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE value > 120) GROUP BY key""")
def stream_pending(spark, d):
    """Keys of users and kinds of events that are not finished (a value over 120), each once, though half of the log comes twice."""
    key = F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("event_type", F.lit(""))).alias("key")
    events = table(spark, d, "events")
    done = events.where("value > 120").select(key)
    rows = events.select(F.col("event_id").alias("seq"), key, "ts")
    return _runs(rows, "seq", "update", lambda s: resume.pending(s, done, "key", "seq", "ts", "1000 days"), again=True)[-1].select("seq", "key")


COUNTS = "SELECT {run} AS run, config_b AS config, count(*) FILTER (WHERE winner = config_b)::BIGINT AS wins, count(*) FILTER (WHERE winner = config_a)::BIGINT AS losses, count(*) FILTER (WHERE winner = 'TIE')::BIGINT AS ties, count(*)::BIGINT AS total FROM judgments {where} GROUP BY config_b"


@query(cte() + COUNTS.format(run=1, where="WHERE seq <= (SELECT (min(seq) + max(seq)) // 2 FROM judgments)") + " UNION ALL " + COUNTS.format(run=2, where=""))
def stream_running_wins(spark, d):
    """Wins so far of each arm, as they stand after each of two runs."""
    rows = judgments(spark, d).select("config_a", "config_b", "winner", "seq")
    parts = _runs(rows, "seq", "update", lambda s: resume.running_wins(s, "base"), again=False)
    shown = [resume.latest(p, "config").select(F.lit(i).alias("run"), "config", "wins", "losses", "ties", "total") for i, p in enumerate(parts, 1)]
    return shown[0].unionByName(shown[1])

"""Trace analytics on unbounded inputs: rows with an event time, the keys of an event, and an action.

State is bounded by time: an item waits for the creation of its event no longer than ``wait``, and a life
ends when nothing names the event for ``idle``. Items later than the watermark are left out, as in any
windowed stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.trace import CREATE, QUERY, TRIGGER, WAIT


def stream_orphans(items: DataFrame, keys: list[str], time: str = "ts", action: str = "action", wait: str = "10 minutes") -> DataFrame:
    """Items whose event isn't created within ``wait`` before or after them; told when the watermark has passed.

    Both sides of an outer join are kept until their time is over. A creation that is repeated within
    that time makes no difference to what is missing. Nulls in a key match nothing.
    """
    seen = items.withWatermark(time, wait)
    others = seen.where(F.col(action) != CREATE)
    made = seen.where(F.col(action) == CREATE).select(*[F.col(k).alias(f"made_{k}") for k in keys], F.col(time).alias("made_at"))
    span = F.expr(f"INTERVAL {wait}")
    near = (F.col("made_at") >= F.col(time) - span) & (F.col("made_at") <= F.col(time) + span)
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"made_{k}") for k in keys], near)
    return others.join(made, match, "left_outer").where("made_at IS NULL").select(*items.columns)


def stream_lifetimes(items: DataFrame, keys: list[str], time: str = "ts", action: str = "action", idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(keys, created, triggered, last_use, n_queries, n_waits) of each life that was created, once it has ended."""

    def when(a: int):
        return F.when(F.col(action) == a, F.col(time))

    return (
        items.withWatermark(time, late).groupBy(*keys, F.session_window(time, idle))
        .agg(F.min(when(CREATE)).alias("created"), F.max(when(TRIGGER)).alias("triggered"), F.max(time).alias("last_use"),
             F.count(when(QUERY)).alias("n_queries"), F.count(when(WAIT)).alias("n_waits"))
        .where("created IS NOT NULL").drop("session_window")
    )


def stream_counts(items: DataFrame, keys: list[str], width: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(keys, start, n) for tumbling windows of ``width``, once the watermark has passed them."""
    return items.withWatermark(time, late).groupBy(*keys, F.window(time, width)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")

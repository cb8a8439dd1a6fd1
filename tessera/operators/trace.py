"""Analytics over traces of events and locks: rows (time, node, id, gen, action)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import running_sums

CREATE, QUERY, TRIGGER, WAIT = 0, 1, 2, 3


def orphans(trace: DataFrame, keys: list[str], action: str = "action") -> DataFrame:
    """Items whose event was never created."""
    created = trace.where(F.col(action) == CREATE).select(*keys).distinct()
    return trace.where(F.col(action) != CREATE).join(created, keys, "left_anti")


def lifetimes(trace: DataFrame, keys: list[str], time: str = "time", action: str = "action") -> DataFrame:
    """(keys, created, triggered, last_use, n_queries, n_waits) of the events that were created."""

    def when(a: int) -> Column:
        return F.when(F.col(action) == a, F.col(time))

    return (
        trace.groupBy(*keys)
        .agg(F.min(when(CREATE)).alias("created"), F.max(when(TRIGGER)).alias("triggered"), F.max(time).alias("last_use"),
             F.count(when(QUERY)).alias("n_queries"), F.count(when(WAIT)).alias("n_waits"))
        .where("created IS NOT NULL").withColumn("last_use", F.greatest("last_use", "created"))
    )


def live_curve(lives: DataFrame, width: int, start: str = "created", end: str = "last_use") -> DataFrame:
    """(time, live): +1 at the start, -1 at the end, summed by time first; intervals of no length don't count."""
    some = lives.where(F.col(end) > F.col(start))
    steps = some.select(F.col(start).alias("time"), F.lit(1).alias("d")).union(some.select(F.col(end), F.lit(-1)))
    by_time = steps.groupBy("time").agg(F.sum("d").alias("d"))
    return running_sums(by_time, F.floor(F.col("time") / width), ["time"], {"live": F.col("d")}).select("time", "live")


def waiter_ratio(trace: DataFrame, keys: list[str], owner: str, node: str, action: str = "action") -> DataFrame:
    """(keys, n_waiters, n_local, ratio) of events that something waits for."""
    waits = trace.where(F.col(action) == WAIT)
    return waits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_waiters"), F.count_if(F.col(node) == F.col(owner)).alias("n_local")).withColumn(
        "ratio", F.round(F.col("n_local") / F.col("n_waiters"), 6))


#: Actions of a lock trace.
LOCAL_REQUEST, REMOTE_REQUEST, FORWARD, LOCAL_GRANT, REMOTE_GRANT, REMOTE_RELEASE = range(6)


def lock_stats(trace: DataFrame, lock: str, action: str = "action") -> DataFrame:
    names = ["local_requests", "remote_requests", "forwards", "local_grants", "remote_grants", "remote_releases"]
    return trace.groupBy(lock).agg(*[F.count_if(F.col(action) == k).alias(n) for k, n in enumerate(names)])

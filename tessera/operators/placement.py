"""Placement policies: which processor runs a task, which tasks may be stolen, which memories are used.

Machines are small tables (processors, memories, affinities); tasks may be many. Nothing here
gathers a queue: a policy reads the head of each queue and what the head's regions lead to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks that one theft may take, and thefts that one task may undergo.
MOST_STOLEN, MOST_THEFTS = 4, 2


def heads(tasks: DataFrame, by: list[str], seq: str, k: int) -> DataFrame:
    """The first ``k`` rows of each queue by ``seq``."""
    w = Window.partitionBy(*by).orderBy(seq)
    return tasks.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def greedy(tasks: list[tuple[int, list]], quota: int) -> list[int]:
    """The first task not taken leads; later ones that share a region with it follow; until ``quota`` are taken."""
    taken: dict[int, None] = {}
    for i, (seq, regions) in enumerate(tasks):
        if seq in taken:
            continue
        for s, r in tasks[i:]:
            if len(taken) == quota:
                return list(taken)
            if s not in taken and (s == seq or set(r) & set(regions)):
                taken[s] = None
    return list(taken)


def permitted_steals(tasks: DataFrame, queue: str, seq: str, regions: str, thefts: str, quota: int = MOST_STOLEN, most_thefts: int = MOST_THEFTS) -> DataFrame:
    """(queue, seq, rank): the tasks of each queue that a thief gets; ``regions`` is an array, ``seq`` is unique in a queue.

    Tasks stolen ``most_thefts`` times stay. With a quota of q the leaders are among the first q
    tasks of a queue, and who follows one by a region is among the first q of that region: only
    these are gathered.
    """
    free = tasks.where(F.coalesce(F.col(thefts), F.lit(0)) < most_thefts).select(
        F.col(queue).alias("queue"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.array_distinct(regions), F.array().cast(tasks.schema[regions].dataType)).alias("regions"))
    first = heads(free, ["queue"], "seq", quota)
    led_by = first.select("queue", F.explode("regions").alias("region")).distinct()
    follow = free.select("queue", "seq", "regions", F.explode("regions").alias("region")).join(led_by, ["queue", "region"], "left_semi")
    few = first.union(heads(follow, ["queue", "region"], "seq", quota).select("queue", "seq", "regions")).dropDuplicates(["queue", "seq"])
    lists = few.groupBy("queue").agg(F.sort_array(F.collect_list(F.struct("seq", F.transform("regions", lambda r: r.cast("string")).alias("regions")))).alias("tasks"))
    kind = tasks.schema[queue].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [greedy([(t["seq"], t["regions"]) for t in ts], quota) for ts in b.column(1).to_pylist()]
            at = pa.array([i for i, g in enumerate(got) for _ in g], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array([s for g in got for s in g], pa.int64()), pa.array([k + 1 for g in got for k in range(len(g))], pa.int32())], names=["queue", "seq", "rank"])

    return lists.mapInArrow(run, f"queue {kind}, seq long, rank int").withColumnsRenamed({"queue": queue, "seq": seq})


def steal_targets(processors: DataFrame, blacklist: DataFrame, turn: int = 0) -> DataFrame:
    """(thief, victim): from each processor (proc) another one that its blacklist (thief, proc) doesn't hold; null if none.

    The choice goes round with ``turn``. The list of all processors of the machine stands in each row.
    """
    every = processors.agg(F.sort_array(F.collect_set("proc")).alias("every"))
    barred = blacklist.groupBy("thief").agg(F.collect_set("proc").alias("barred"))
    rows = processors.select(F.col("proc").alias("thief")).distinct().join(barred, "thief", "left").join(F.broadcast(every))
    left = F.array_except("every", F.concat(F.coalesce("barred", F.slice("every", 1, 0)), F.array("thief")))
    return rows.select("thief", left.alias("left")).select("thief", F.when(F.size("left") > 0, F.get("left", F.lit(turn) % F.size("left"))).alias("victim"))


def target_processors(tasks: DataFrame, variants: DataFrame, processors: DataFrame, prefer: list[str], local: str = "local_proc", fn: str = "fn", task: str = "task_id") -> DataFrame:
    """(task, proc): the local processor if a variant (fn, kind) runs there, else one of the first kind in ``prefer`` that has both; null if none.

    Tasks are dealt to the processors (proc, kind) of a kind by their id.
    """
    able = processors.where(F.col("kind").isin(prefer)).groupBy("kind").agg(F.sort_array(F.collect_set("proc")).alias("procs"))
    rank = F.array_position(F.array(*[F.lit(k) for k in prefer]), F.col("kind"))
    other = variants.join(able, "kind").groupBy("fn").agg(F.min_by("procs", rank).alias("procs"))
    here = variants.join(processors, "kind").select("fn", F.col("proc").alias("here")).distinct()
    rows = tasks.select(F.col(task).alias("task_id"), F.col(fn).alias("fn"), F.col(local).alias("local"))
    rows = rows.join(here, (rows["fn"] == here["fn"]) & (rows["local"] == here["here"]), "left").select("task_id", rows["fn"], "here").join(other, "fn", "left")
    return rows.select(F.col("task_id").alias(task), F.coalesce("here", F.get("procs", F.pmod("task_id", F.size("procs")).cast("int"))).alias("proc"))


def memory_stack(affinities: DataFrame, by: str = "bandwidth") -> DataFrame:
    """(processor, memory, rank): most bandwidth or least latency first; ties by name."""
    first: Column = F.desc("bandwidth") if by == "bandwidth" else F.asc("latency")
    return affinities.select("processor", "memory", F.row_number().over(Window.partitionBy("processor").orderBy(first, "memory")).alias("rank"))


def copy_targets(requests: DataFrame, instances: DataFrame, stack: DataFrame) -> DataFrame:
    """(request, memory, action, rank): the instances that a request's region has are reused; without one, one is created where the stack allows."""
    has = requests.join(instances, "region").select("request", "memory", F.lit("reuse").alias("action"), F.lit(None).cast("int").alias("rank"))
    none = requests.join(instances, "region", "left_anti").join(stack, "processor")
    return has.union(none.select("request", "memory", F.lit("create"), "rank"))


def copy_sources(copies: DataFrame, instances: DataFrame, affinities: DataFrame) -> DataFrame:
    """(copy, memory, rank): only the destination if it holds an instance, else instances by bandwidth to it; without any link, the first by name."""
    held = copies.select("copy", "region", "destination").join(instances, "region")
    links = affinities.select(F.col("source").alias("memory"), "destination", "bandwidth")
    held = held.join(links, ["memory", "destination"], "left").withColumn("is_there", F.col("memory") == F.col("destination"))
    order = Window.partitionBy("copy").orderBy(F.desc("is_there"), F.desc_nulls_last("bandwidth"), "memory")
    ranked = held.withColumn("rank", F.row_number().over(order)).withColumn("best", F.first("is_there").over(order))
    return ranked.where((F.col("rank") == 1) | (~F.col("best") & F.col("bandwidth").isNotNull())).select("copy", "memory", "rank")


def blocking_factor(kind: Column, most: Column, blocked: str = "gpu") -> Column:
    """Fully blocked (a column for each field) on processors of kind ``blocked``, else 1: rows."""
    return F.when(kind == blocked, most).otherwise(F.lit(1))

"""Event graphs and requirement tests of operation logs, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import depend as D
from tessera.operators.graph import reach
from tessera.operators.shared import dealt, written

#: All bits of a 64-field mask.
ALL_FIELDS = -1


def aliased_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) for the index spaces of a tree (node, parent, kind, disjoint) that may share pointers.

    Two spaces may where one lies within the other, and where their paths part at a space or at a partition that
    isn't disjoint. Spaces of different trees never do. The table of nodes is a catalog: small.
    """
    up = reach(nodes.where("parent IS NOT NULL"), "node", "parent").union(nodes.select("node", "node"))
    depth = up.groupBy("src").agg(F.count(F.lit(1)).alias("depth"))
    a, b = up.toDF("a", "top"), up.toDF("b", "top")
    met = a.join(b, "top").join(depth.withColumnRenamed("src", "top"), "top")
    lowest = met.groupBy("a", "b").agg(F.max_by("top", "depth").alias("top"))
    spaces = nodes.where("kind = 'space'").select("node")
    lowest = lowest.join(spaces.withColumnRenamed("node", "a"), "a", "left_semi").join(spaces.withColumnRenamed("node", "b"), "b", "left_semi")
    where = nodes.select(F.col("node").alias("top"), "kind", "disjoint")
    within = (F.col("a") == F.col("top")) | (F.col("b") == F.col("top"))
    return lowest.join(where, "top").where(within | (F.col("kind") == "space") | ~F.col("disjoint")).select("a", "b")


def requirement_test(requirements: DataFrame, aliased: DataFrame) -> DataFrame:
    """(ctx, prev, next, dtype) of requirements (ctx, seq, tree, node, fields bigint mask, priv, coher, redop).

    Two depend on each other where they name a common field, are of one tree and their nodes may share pointers.
    Quadratic in the requirements of a context and tree, which is what the test asks; ``field_epochs`` is the linear form.
    """
    a, b = requirements.alias("a"), requirements.alias("b")
    met = a.join(b, (F.col("a.ctx") == F.col("b.ctx")) & (F.col("a.tree") == F.col("b.tree")) & (F.col("a.seq") < F.col("b.seq")) & (F.col("a.fields").bitwiseAND(F.col("b.fields")) != 0))
    near = aliased.toDF("x", "y")
    met = met.join(F.broadcast(near), (F.col("a.node") == F.col("x")) & (F.col("b.node") == F.col("y")), "left_semi")
    kind = D.dependence_type(*[F.col(f"{s}.{c}") for s in "ab" for c in ("priv", "coher", "redop")])
    return met.select(F.col("a.ctx").alias("ctx"), F.col("a.seq").alias("prev"), F.col("b.seq").alias("next"), kind.alias("dtype")).where(F.col("dtype") != D.NONE)


def deletion(kind: str, ctx: Column, seq: Column, tree: Column, node: Column, field: int | None = None) -> list[Column]:
    """The requirement of a deletion: read-write and exclusive, over one field where a field is deleted, else over all."""
    if kind not in ("index_space", "index_partition", "field_space", "field", "region", "partition"):
        raise ValueError(f"nothing of the kind {kind!r} is deleted")
    mask = F.lit(1 << field if kind == "field" else ALL_FIELDS).cast("long")
    return [ctx.alias("ctx"), seq.alias("seq"), tree.alias("tree"), node.alias("node"), mask.alias("fields"), F.lit(D.READ_WRITE).alias("priv"), F.lit(D.EXCLUSIVE).alias("coher"), F.lit(0).alias("redop")]


def field_epochs(requirements: DataFrame, n_fields: int = 64) -> DataFrame:
    """(ctx, tree, node, field, seq, usage, epoch, opens): requirements by field; opens tells who begins an epoch.

    A user of another class than the one before it, and every writer, closes the epoch of a field: it dominates all users in it.
    Of users with one seq writers come first, then reductions, then readers, so that the result doesn't hang on the order of the rows.
    """
    one = requirements.withColumn("field", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_fields - 1)), lambda i: F.getbit("fields", i) == 1)))
    key = ["ctx", "tree", "node", "field"]
    w = Window.partitionBy(*key).orderBy("seq")
    usage = F.when(D.reads_only(F.col("priv")), "read").when(F.col("priv") == D.REDUCE, "reduce").otherwise("write")
    rows = one.withColumn("usage", usage).withColumn("before", F.lag("usage").over(Window.partitionBy(*key).orderBy("seq", F.desc("usage"))))
    rows = rows.withColumn("opens", F.col("before").isNull() | (F.col("before") != F.col("usage")) | (F.col("usage") == "write"))
    return rows.withColumn("epoch", F.sum(F.col("opens").cast("int")).over(w)).select(*key, "seq", "usage", "epoch", "opens")


def dominator_masks(epochs: DataFrame) -> DataFrame:
    """(ctx, tree, node, seq, mask): the fields of which a user begins an epoch that isn't the first, as bits."""
    opened = epochs.where("opens AND epoch > 1")
    return opened.groupBy("ctx", "tree", "node", "seq").agg(F.bit_or(F.expr("shiftleft(1L, field)")).alias("mask"))


def event_nodes(log: dict[str, DataFrame]) -> DataFrame:
    """(op, start_id, start_gen, term_id, term_gen): an instance for each point of a task, copy and mapping of an operation log."""
    events = ["start_id", "start_gen", "term_id", "term_gen"]
    task = log["task_events"].select(F.format_string("task %d %d", "uid", "point").alias("op"), *events)
    copy = log["copy_events"].select(F.format_string("copy %d.%d", "start_id", "start_gen").alias("op"), *events)
    mapped = log["map_events"].select(F.format_string("map %d", "uid").alias("op"), *events)
    return task.union(copy).union(mapped)


def event_edges(log: dict[str, DataFrame]) -> DataFrame:
    """(src, dst): start event -> operation -> termination event, event -> event, and points -> the termination of their index launch."""
    def event(i: str, g: str) -> Column:
        return F.format_string("event %d.%d", i, g)

    # Each operation is read once for its edge in and its edge out.
    ends = F.array(F.struct(event("start_id", "start_gen").alias("src"), F.col("op").alias("dst")), F.struct(F.col("op").alias("src"), event("term_id", "term_gen").alias("dst")))
    through = event_nodes(log).select(F.explode(ends).alias("e")).select("e.src", "e.dst")
    between = log["event_event"].select(event("id1", "gen1"), event("id2", "gen2"))
    points = log["task_events"].where("index_space = 1").select("uid", event("term_id", "term_gen").alias("src"))
    whole = points.join(log["index_term"].select("uid", event("term_id", "term_gen").alias("dst")), "uid").select("src", "dst")
    every = written(through.union(between).union(whole), "event-edges")
    return dealt(every, every.count(), "src", "dst").distinct()


def collapsed(edges: DataFrame) -> DataFrame:
    """(src, dst) between operations: paths whose inner nodes are events only. Runs as many rounds as the longest such path has hops."""
    is_event = F.col("dst").startswith("event ")
    edges = written(edges, "edges")
    steps = edges.where(F.col("src").startswith("event ")).select(F.col("src").alias("at"), "dst")
    front, done, found, n_steps = edges.where(~F.col("src").startswith("event ")), None, 0, steps.count()
    while True:
        direct, waits = front.where(~is_event), front.where(is_event).select("src", F.col("dst").alias("at"))
        done, found = direct if done is None else done.union(direct), found + direct.count()
        if not (n := waits.count()):
            return dealt(done, found, "src", "dst").distinct()
        hop = written(dealt(waits, n + n_steps, "at").join(dealt(steps, n + n_steps, "at"), "at").select("src", "dst"), "hop")
        front = written(dealt(hop, hop.count(), "src", "dst").distinct(), "front")


def found_upward(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): the pairs with a path, where each edge goes from a lesser node to a greater one.

    A path to dst then meets no node beyond it, so each pair is followed no further than that. Runs as many rounds as the longest path within a pair has edges.
    """
    hops, found, n_edges = edges.toDF("at", "to"), None, edges.count()
    front = written(pairs.where("src < dst").select("src", "dst", F.col("src").alias("at")).distinct(), "pairs")
    while True:
        n = front.count() + n_edges
        hop = dealt(front, n, "at").join(dealt(hops, n, "at"), "at").where("to <= dst").select("src", "dst", F.col("to").alias("at"))
        hop = written(hop, "hop")
        hop = written(dealt(hop, hop.count(), "src", "dst").distinct(), "front")
        met = hop.where("at = dst").select("src", "dst")
        found = met if found is None else found.union(met)
        front = hop.join(met, ["src", "dst"], "left_anti")
        if front.isEmpty():
            return found


def edge_report(dependences: DataFrame, logged: DataFrame) -> DataFrame:
    """(side, src, dst): dependences without a path of logged edges ('missing'), and logged edges that aren't dependences ('extra')."""
    logged, dependences = written(logged, "logged"), written(dependences, "dependences")
    # The later operation waits for the earlier one, so ids go up along the edges of a log; elsewhere all paths are told.
    upward = logged.where("src >= dst").isEmpty()
    paths = found_upward(dependences, logged) if upward else reach(logged)
    n = logged.count() + dependences.count()
    logged, dependences, paths = (dealt(x, n, "src", "dst") for x in (logged, dependences, paths))
    missing = dependences.join(paths, ["src", "dst"], "left_anti").select(F.lit("missing").alias("side"), "src", "dst")
    return missing.union(logged.join(dependences, ["src", "dst"], "left_anti").select(F.lit("extra"), "src", "dst"))

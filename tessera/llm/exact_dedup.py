"""Exact duplicates through an extendible-hash index on shared files, in DataFrame operations only.

1. Each row's key (XXH64 of the normalised text, mixed once more) is written with its id and
   content digest: narrow rows, no text.
2. ``directory`` doubles until no bucket holds more keys than its capacity: a bucket that is
   too full is split by one more bit of the key, the others keep theirs and are shared by
   several slots. There is no largest depth. A bucket of one key cannot be split further: its
   entries are chained. The directory is a table (slot, bucket), written in the shared folder.
3. Texts go to the owner task of their bucket, which the directory tells: it takes all of the
   bucket's key range, compares bytes and chains texts whose keys collide. Keys with over
   1 / HOT_SHARES of all rows don't go there: their copies are combined before the shuffle, and
   their entries are written as chains of the same bucket.
4. Rows look up their entry through the directory: by bucket, key and digest. Entries of one
   key whose digests agree although their bytes do not (the digest is a parameter) are told
   apart by a join on the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import HOT_SHARES, table, with_labels, with_row_key, written

#: Keys of a bucket; slots of a directory that is broadcast (16 bytes each), beyond which it is joined by a shuffle.
CAPACITY, MAX_BROADCAST_SLOTS = 8_192, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def slot_of(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((slot, bucket, depth), global depth) for the distinct keys (h long) of a table.

    Begins with one bucket of depth 0. While a bucket holds more than ``capacity`` keys, it is
    split; where it is as deep as the directory, this doubles. A bucket is named by its depth
    and first bits, as bits << 8 | depth, and every slot below it leads to it.
    """
    depth = 0
    n = keys.count()
    while n > capacity << depth:
        depth += 1
    while True:
        # Keys of every slot; summed up for the buckets of each depth that the slot could belong to.
        slots = keys.groupBy(slot_of(F.col("h"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        up = slots.select("n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "slot")
        full = written(
            up.groupBy("d", F.expr(f"shiftright(slot, {depth} - d)").alias("bits")).agg(F.sum("n").alias("n")).where(F.col("n") > capacity), "overfull")
        if full.where(F.col("d") == depth).isEmpty() or depth >= 60:
            break
        depth += 1  # the directory doubles
    every = keys.sparkSession.range(1 << depth).select(F.col("id").alias("slot"))
    below = F.explode(F.expr(f"sequence(shiftleft(bits, {depth} - d), shiftleft(bits + 1, {depth} - d) - 1)"))
    split = full.where(F.col("d") < depth).select("d", below.alias("slot")).groupBy("slot")
    local = every.join(split.agg((F.max("d") + 1).alias("depth")), "slot", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    slots = local.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {depth} - depth), 8) + depth"))
    return written(slots.select("slot", "bucket", "depth"), "directory"), depth


def with_bucket(rows: DataFrame, slots: DataFrame, depth: int, most: int) -> DataFrame:
    """``rows`` (h) with the bucket that the directory gives for their key."""
    if 1 << depth <= most:
        slots = F.broadcast(slots)
    return rows.withColumn("slot", slot_of(F.col("h"), depth)).join(slots.select("slot", "bucket"), "slot").drop("slot")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_broadcast: int = MAX_BROADCAST_SLOTS,
    key=F.xxhash64, digest=lambda c: F.sha2(c, 256), hot_shares: int = HOT_SHARES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, entries, texts): rows (id, h, tag, sha, bucket); entries (bucket, h, tag, keep_id, group_size, chained), written by their
    owners; texts are the rows (id, norm, h, bucket), not written. An entry is one text; chained tells how many of its key have its digest."""
    mixed = F.xxhash64(key(F.col("norm")))
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("h", mixed)
    rows = written(texts.select("id", "h", digest(F.col("norm")).alias("tag"), F.sha2("norm", 256).alias("sha")), "index-rows")
    counts = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")), "index-keys")
    slots, depth = directory(counts.select("h"), capacity)
    hot = F.broadcast(counts.where(F.col("copies") * hot_shares > rows.count()).select("h"))  # fewer than hot_shares keys
    texts = with_bucket(texts, slots, depth, max_broadcast)
    one = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    entry = ["bucket", "h", digest(F.col("norm")).alias("tag"), "keep_id", "group_size"]
    # The owner has all rows of its buckets, so the grouping by key and bytes happens there.
    owned = texts.join(hot, "h", "left_anti").repartition("bucket").groupBy("bucket", "h", "norm").agg(*one).select(*entry)
    heavy = texts.join(hot, "h", "left_semi").groupBy("bucket", "h", "norm").agg(*one).select(*entry)
    chained = F.count(F.lit(1)).over(Window.partitionBy("bucket", "h", "tag")).alias("chained")
    entries = written(owned.select("*", chained), "index-entries").union(written(heavy.select("*", chained), "index-hot-entries"))
    return with_bucket(rows, slots, depth, max_broadcast), entries, texts


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_broadcast: int = MAX_BROADCAST_SLOTS,
    key=F.xxhash64, digest=lambda c: F.sha2(c, 256), hot_shares: int = HOT_SHARES,
) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when the same after lower-casing A-Z; null counts as empty, so null and
    empty texts form one group. The largest id of a group stays; rows whose id is null stay
    only where no row of the group has an id. Repeated rows of one id count one each in
    group_size and are marked alike. An empty table gives an empty one; other columns are
    not read. ``key`` and ``digest`` can be replaced by weaker ones: the result is the same.
    """
    rows, entries, texts = build_index(docs, id_col, text_col, capacity, max_broadcast, key, digest, hot_shares)
    rows = written(rows, "addressed-rows")
    chained = entries.where("chained > 1").select("bucket", "h", "tag").distinct()
    own = entries.where("chained = 1").select("bucket", "h", "tag", "keep_id", "group_size", F.col("group_size").alias("copies"))
    out = with_labels(rows, own, ["bucket", "h", "tag"], "copies").select("id", "keep_id", "group_size", "sha", "bucket")
    if not chained.isEmpty():  # equal key and digest, other bytes
        some = texts.withColumn("tag", digest(F.col("norm"))).join(chained, ["bucket", "h", "tag"], "left_semi")
        told = some.groupBy("bucket", "h", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.union(some.join(told, ["bucket", "h", "norm"]).select("id", "keep_id", "group_size", F.sha2("norm", 256), "bucket"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"), "bucket",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    def named(sha: Column) -> Column:
        return F.concat_ws(":", sha, F.coalesce(F.col(id_col).cast("string"), F.lit("null")))

    key = with_row_key(docs, id_col, text_col)[1]
    keep = exact_groups(docs, id_col, text_col).where("kept").select(named(F.col("text_sha256")).alias(key))
    mine = docs.withColumn(key, named(F.sha2(normalised(F.col(text_col)), 256)))
    # Both steps deal by the key: one shuffle of the texts. Rows repeated under the id that stays become one.
    return mine.join(keep, key, "left_semi").dropDuplicates([key]).drop(key)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

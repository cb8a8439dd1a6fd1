"""Best-fit packing of documents into training sequences, with conflicts.

A bin is a sequence of ``capacity`` words. Bins are ordered by what room they have left;
each carries a bitmap of its sources and duplicate clusters. A piece goes to the tightest
bin that has room and shares neither source nor cluster with it. The successor search goes
up a tree over the residuals whose nodes hold the intersection of the bitmaps below them:
where that holds a bit of the piece, every bin below conflicts and the whole range is
passed over; otherwise the search goes on until a compatible bin is found.

Rows are dealt evenly to shards of about ``shard_items`` documents, whatever their source
or cluster, and each shard fills its own bins: no task grows with a hot source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table
from tessera.llm.exact_dedup import normalised


class Bins:
    """Open bins by residual; bit 0 of a node is set if no bin lies below it."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1 << (capacity + 1).bit_length()
        self.node = [-1] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask: list[int] = []
        self.room: list[int] = []

    def _refresh(self, residual: int) -> None:
        all_of = -1
        for b in self.at[residual]:
            all_of &= self.mask[b]
        i, node = residual + self.size, self.node
        node[i] = all_of
        while i > 1:
            i >>= 1
            new = node[2 * i] & node[2 * i + 1]
            if node[i] == new:
                break
            node[i] = new

    def _leaf(self, i: int, query: int) -> int | None:
        """The first residual from i on whose bins don't all hold one and the same bit of the query."""
        node, size = self.node, self.size
        i += size
        while True:
            if not node[i] & query:
                while i < size:
                    i *= 2
                    if node[i] & query:
                        i += 1
                if not node[i] & query:
                    return i - size
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1

    def best(self, need: int, bits: int) -> int | None:
        """The compatible bin with least room that is enough; of equals the oldest."""
        query, r = bits | 1, need
        while (found := self._leaf(r, query)) is not None:
            for b in self.at[found]:
                if not self.mask[b] & bits:
                    return b
            r = found + 1
        return None

    def put(self, need: int, bits: int) -> tuple[int, int]:
        """(bin, offset in it)"""
        b = self.best(need, bits)
        if b is None:
            b = len(self.mask)
            self.mask.append(0)
            self.room.append(self.capacity)
        else:
            self.at[self.room[b]].remove(b)
            self._refresh(self.room[b])
        offset = self.capacity - self.room[b]
        self.room[b] -= need
        self.mask[b] |= bits
        self.at[self.room[b]].append(b)
        self._refresh(self.room[b])
        return b, offset


def pack_shard(items: list[tuple], capacity: int) -> list[tuple]:
    """(item, piece, bin or None, start, length, offset) for items (length, source, cluster), longest first."""
    bins, bit = Bins(capacity), {}
    seen: dict = {}
    for _, _, c in items:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1

    def bits(source, cluster) -> int:
        out = 0
        for key in (None if source is None else ("s", source), None if seen.get(cluster, 0) < 2 else ("c", cluster)):
            if key is not None:
                out |= bit.setdefault(key, 2 << len(bit))
        return out

    out, rest = [], []
    for i, (length, source, cluster) in enumerate(items):
        if not length:
            out.append((i, 0, None, 0, 0, 0))
            continue
        own, full = bits(source, cluster), length // capacity
        for p in range(full):
            b, offset = bins.put(capacity, own)
            out.append((i, p, b, p * capacity, capacity, offset))
        if length % capacity:
            rest.append((-(length % capacity), i, full, own))
    for need, i, p, own in sorted(rest):
        b, offset = bins.put(-need, own)
        out.append((i, p, b, p * capacity, -need, offset))
    return out


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        items = list(zip(*(t.column(c).to_pylist() for c in ("length", "source", "cluster")), strict=True))
        rows = pack_shard(items, capacity)
        first = TaskContext.get().partitionId() << 32
        item, piece, bins, start, length, offset = map(list, zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                t.column("id").combine_chunks().take(pa.array(item)), pa.array(piece, pa.int32()),
                pa.array([None if b is None else first + b for b in bins], pa.int64()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(offset, pa.int64()),
            ],
            names=["id", "piece", "bin_id", "start", "n_words", "bin_offset"],
        )

    return run


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_fit_pack(
    docs: DataFrame, length: Column, capacity: int = 2048, id_col: str = "doc_id", source_col: str | None = "source",
    cluster: Column | None = None, shard_items: int = 4096,
) -> DataFrame:
    """Rows (id_col, piece, bin_id, start, n_words, bin_offset): which words of a document lie where in which bin.

    A document longer than ``capacity`` is cut into pieces of that length and a rest. Two
    documents of one source or one cluster never share a bin; a null source or cluster
    conflicts with none. A document of length 0 or null has one row with a null bin_id.
    Repeated rows and null ids are packed like any others; ties go to the oldest bin. Every
    row of the input has at least one row; an empty table gives an empty one. Other columns
    are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    items = docs.select(
        F.col(id_col).alias("id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("length"),
        (F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")).alias("source"),
        (F.lit(None) if cluster is None else cluster).cast("long").alias("cluster"),
    )
    shards = max(1, -(-docs.select(F.lit(1)).count() // shard_items))
    return items.repartition(shards).mapInArrow(
        _pack(capacity), f"id {kind}, piece int, bin_id long, start long, n_words long, bin_offset long"
    ).withColumnRenamed("id", id_col)


def packed(docs: DataFrame) -> DataFrame:
    """``documents`` into bins of 2048 words; exact copies (A-Z lower-cased) are one cluster."""
    return best_fit_pack(docs, word_count(F.col("text")), cluster=F.xxhash64(normalised(F.col("text"))))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))

"""SimHash near-duplicates, with candidates from pigeonring chains.

The 64 bits stand in a ring of four 16-bit segments. If two fingerprints differ in at most
three bits, some segment begins a chain whose first l segments differ in at most
floor(3 l / 4) bits for every l: 0, 1, 2 and 3. So the first segment of that chain is equal
and the second differs in one bit at most. A fingerprint is filed under the 32 bits of each
such pair of segments as they are, and with each set bit of the second one cleared: the two
partners of a chain always meet under one of these keys. Rows that meet are tested against
the budgets of the longer chains and then by the whole Hamming distance.

Comparing all that meet under a key costs the square of their number, so a key with more than
MOST fingerprints (a very large group of near copies) is left to another exact way, whose cost
grows with their number alone: each of its fingerprints is filed under all values that differ
from it in two bits at most. Those that lie within one bit of a value are linked with all that
lie within two bits of it, and two fingerprints that differ in three bits meet so at some value.

Three bits of one SimHash tell copies with very few changes. ``near_text_clusters`` looks for
texts whose sets of five-word shingles have a similarity of about 0.8 or more, whatever their
length: its fingerprint has 16 segments, each the SimHash of the six least hashes among its share
of the shingles, so that changes leave many segments as they are. The same ring of segments
serves, with whole segments as the differences: where at most 11 of 16 differ, some segment begins
a chain with the budgets 0, 1, 2 and 2 for its first 1, 2, 3 and 4 segments (floor(11 l / 16)). Such a chain,
an equal segment with another equal one among the next three, makes two texts candidates. Short texts
and texts that quote one passage meet so too without being alike, so the whole Hamming distance of
the 512 bits decides: DISTANCE at most. What meets under a key is tested against one of them, the hub;
those that are too far from it are tested against each other, and against those near it whose distance
from it is less by DISTANCE at most. By the triangle inequality no others can be near them, and the
rows near a hub need no test against each other, since the hub connects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship, with_labels, written
from tessera.operators.graph import linked_components

SEGMENTS = 4
BITS = 16
#: Shingles whose bits are counted at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 15
#: Fingerprints that are compared under one key; keys with more of them that are taken out before the shuffle.
MOST, LARGEST_KEYS = 1 << 14, 10_000
#: Segments of the fingerprint of ``near_text_clusters``, least hashes that each is made of, and segments of a chain.
SHARES, LEAST_HASHES, CHAIN = 16, 6, 4
#: Differing bits of those 16 segments of 32 bits (99 of 100 candidates of similarity 0.8 to 0.85 have no more), and rows far from their hub that one block of a key holds.
DISTANCE, FAR_BLOCK = 90, 1024


def fingerprint(text: bytes | None, width: int) -> int:
    """The 64-bit SimHash, unsigned. Null and texts without a word give 0."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        first = starts[at:to].tolist()
        last = ends[at + width - 1 : to + width - 1].tolist() if len(words) >= width else [len(joined)]
        h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(first, last, strict=True)), np.uint64, to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column("text")), np.uint64, b.num_rows)
            rest = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(fp.view(np.int64))], names=[*rest, "fp"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): 4 keys as they are and one more for each set bit of a second segment."""
    for b in batches:
        whole = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(whole), 4096):
            fp = whole[at : at + 4096]
            keys, of = [], []
            for i in range(SEGMENTS):
                one = (fp >> np.uint64(BITS * i)) & np.uint64(0xFFFF)
                two = (fp >> np.uint64(BITS * ((i + 1) % SEGMENTS))) & np.uint64(0xFFFF)
                head = (np.uint64(i) << np.uint64(32)) | (one << np.uint64(BITS))
                keys.append(head | two)
                of.append(fp)
                for p in range(BITS):
                    bit = np.uint64(1 << p)
                    on = (two & bit) != 0
                    keys.append((head | (two ^ bit))[on])
                    of.append(fp[on])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(of).view(np.int64))], names=["key", "fp"]
            )


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while a.size:
        ra, rb = _root(parent, a), _root(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent[a] = _root(parent, a)


def _within(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked under each key: a star for each class, not all pairs.

    key and fp are sorted by key, then fp, without repeated rows.
    """
    n = len(key)
    parent = np.arange(n)
    low = np.arange(n - 1)
    rot = (key >> 32).astype(np.uint64) * np.uint64(BITS)
    shift = 1
    while low.size:
        low = low[: np.searchsorted(low, n - shift)]
        low = low[key[low] == key[low + shift]]
        if not low.size:
            break
        x = fp[low] ^ fp[low + shift]
        r = rot[low]
        # The ring is turned so that the chain begins at bit 0.
        x = (x >> r) | np.where(r == 0, np.uint64(0), x << ((np.uint64(64) - r) & np.uint64(63)))
        good = np.ones(len(x), bool)
        for length in range(1, SEGMENTS + 1):
            mask = np.uint64((1 << (BITS * length)) - 1)
            good &= np.bitwise_count(x & mask) <= most * length // SEGMENTS
        _union(parent, low[good], low[good] + shift)
        shift += 1
    root = _root(parent, np.arange(n)) if n else parent
    child = np.flatnonzero(root != np.arange(n))
    return fp[child], fp[root[child]]


def _links(bits: int, most: int = MOST):
    """Links (u, v) of the keys; the fingerprints of a key with more than ``most`` are passed on as (u, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, large = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def flush(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
            a, b = _within(k[new], f[new], bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        def passed_on(f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.nulls(len(f), pa.int64())], names=["u", "v"])

        for b in batches:
            k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if large is not None:  # the rest of a key that has begun to be passed on
                cut = int(np.searchsorted(k, large, "right"))
                yield passed_on(f[:cut])
                k, f = k[cut:], f[cut:]
                if not len(k):
                    continue
                large = None
            key, fp = np.concatenate((key, k)), np.concatenate((fp, f))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            starts = np.flatnonzero(np.concatenate(([True], key[1:cut] != key[: cut - 1]))) if cut else np.empty(0, int)
            sizes = np.diff(np.append(starts, cut))
            over = np.repeat(sizes > most, sizes)
            if over.any():
                yield passed_on(fp[:cut][over])
            if not over.all():
                yield flush(key[:cut][~over], fp[:cut][~over])
            key, fp = key[cut:], fp[cut:]
            if len(key) > most:
                yield passed_on(fp)
                large, key, fp = key[-1], np.empty(0, np.int64), np.empty(0, np.uint64)
        if len(key):
            yield flush(key, fp)

    return run


def _values_near(bits: int):
    """(value, fp, near) for the values that differ from a fingerprint in at most the larger half of ``bits``; near: the smaller half."""
    flips = [sum(1 << i for i in c) for n in range(bits - bits // 2 + 1) for c in combinations(range(64), n)]
    mask, near = np.array(flips, np.uint64), np.array([f.bit_count() <= bits // 2 for f in flips])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 32):
                fp = whole[at : at + 32]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((fp[:, None] ^ mask).ravel().view(np.int64)), pa.array(np.repeat(fp, len(mask)).view(np.int64)),
                        pa.array(np.tile(near, len(fp))),
                    ],
                    names=["value", "fp", "near"],
                )

    return run


def links_by_values(points: DataFrame, bits: int) -> DataFrame:
    """(u, v): links that connect all fingerprints (fp) that differ in at most ``bits`` bits, at most 2081 rows for each.

    What meets at a value lies within two bits of it, so no group has more than 2081 rows.
    """
    at = Window.partitionBy("value")
    met = points.select("fp").mapInArrow(_values_near(bits), "value bigint, fp bigint, near boolean")
    hub = met.withColumn("hub", F.min(F.when(F.col("near"), F.col("fp"))).over(at))
    return hub.where("hub != fp").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def fingerprint_links(points: DataFrame, bits: int = 3, most: int = MOST, largest_keys: int = LARGEST_KEYS) -> DataFrame:
    """(u, v): links that connect all of the distinct fingerprints (fp) that differ in at most ``bits`` bits.

    The largest of the keys with over ``most`` fingerprints are taken out before the shuffle,
    so no task gets them; the others of these are passed on by the task that meets them.
    """
    spark = points.sparkSession
    keys = points.select("fp").mapInArrow(_keys, "key bigint, fp bigint")
    over = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    over = written(over.orderBy(F.desc("n"), "key").limit(largest_keys).select("key"), "large-keys")
    cold, hot = keys, spark.createDataFrame([], "fp bigint")
    if not over.isEmpty():
        cold = keys.join(F.broadcast(over), "key", "left_anti")
        hot = keys.join(F.broadcast(over), "key", "left_semi").select("fp")
    found = written(cold.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(bits, most), "u bigint, v bigint"), "key-links")
    links, passed_on = found.where("v IS NOT NULL"), found.where("v IS NULL").select(F.col("u").alias("fp"))
    if over.isEmpty() and passed_on.isEmpty():
        return links
    hot = written(hot.union(passed_on).distinct(), "hot-points")
    return links.union(links_by_values(hot, bits))


def simhash_clusters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3,
    carry: list[str] | None = None, most_in_key: int = MOST,
) -> DataFrame:
    """(id_col, fingerprint, component_id, the columns in ``carry``), one row for each row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of ``width``
    words, repeats included, are hashed with XXH64 (seed 42); a bit is 1 if set in over half
    of them. Texts of fewer words give one shingle; null, empty and blank texts fingerprint
    0, which links like any other. Fingerprints of at most ``max_bits`` (up to 3) differing
    bits are linked; component_id is the smallest id reachable. Rows with a null id get a
    component if others in it have an id, else null. Repeated rows share their component;
    an empty table gives an empty one. Other columns of ``docs`` are not read.

    Equal fingerprints are first reduced to one row, so a group of copies of any size is one
    point; a key holds only distinct fingerprints that agree in 31 or more of its 32 bits, and
    is compared where it has at most ``most_in_key`` of them; see ``fingerprint_links``. Labels of fingerprints with many copies are broadcast, see ``with_labels``.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the segments are laid out for 3 differing bits at most")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    more = {f"c{i}": c for i, c in enumerate(carry or [])}
    given = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in more.items())
    rows = written(
        docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for n, c in more.items()], F.col(text_col).cast("string").cast("binary").alias("text"))
        .mapInArrow(_fingerprints(width), f"id {kind}{given}, fp bigint"),
        "fingerprints",
    )
    points = written(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "points")
    return _components_of(rows, points, fingerprint_links(points, max_bits, most_in_key)).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *[F.col(n).alias(c) for n, c in more.items()],
    )


def _components_of(rows: DataFrame, points: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (fp, ...) with component_id, the smallest id reachable; points (fp, first_id, copies) are the distinct fingerprints."""
    roots = written(linked_components(links), "roots")
    found = roots.join(points, roots["node"] == points["fp"]).select("root", "fp", "first_id")
    least = found.groupBy("root").agg(F.min("first_id").alias("least_id"))
    of = roots.join(least, "root").select(F.col("node").alias("fp"), "least_id")
    labels = written(points.join(of, "fp", "left").select("fp", "copies", F.coalesce("least_id", "first_id").alias("component_id")), "labels")
    return with_labels(rows, labels, "fp", "copies")


def text_segments(text: bytes | None, width: int) -> np.ndarray:
    """The 16 segments, 32 bits each: a share of the shingles by their hash, the SimHash of the least six of it. 0: an empty share."""
    words = (text or b"").lower().split()
    out = np.zeros(SHARES, np.uint32)
    if not words:
        return out
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    h = np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))
    share = (h % np.uint64(SHARES)).astype(np.int64)
    order = np.argsort(share, kind="stable")  # within a share from the least hash on
    share = share[order]
    begin = np.searchsorted(share, np.arange(SHARES))
    rank = np.arange(len(share)) - begin[share]
    least = rank < LEAST_HASHES
    share, mixed = share[least], ((h[order][least] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")
    bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").astype(np.int64)
    ones, of = np.zeros((SHARES, 32), np.int64), np.bincount(share, minlength=SHARES)
    np.add.at(ones, share, bits)
    segments = np.packbits(ones * 2 > of[:, None], axis=1, bitorder="little").view("<u4").ravel()
    return np.where(of > 0, segments | 1, 0).astype(np.uint32)


def _text_fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments = [text_segments(t.as_py(), width).tobytes() for t in b.column("text")]
            rest = [n for n in b.schema.names if n != "text"]
            fp = np.fromiter((xxhash.xxh64_intdigest(x) for x in segments), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(fp.view(np.int64)), pa.array(segments, pa.binary())], names=[*rest, "fp", "segments"])

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): one key for each chain that a partner could share: a segment and another of the next three, neither empty."""
    mix, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        seg = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, SHARES).astype(np.uint64)
        keys, of = [], []
        for i in range(SHARES):
            for d in range(1, CHAIN):
                one, two = seg[:, i], seg[:, (i + d) % SHARES]
                both = (one != 0) & (two != 0)
                x = ((one << np.uint64(32)) | two)[both] ^ (np.uint64((i * CHAIN + d) * 0x9E3779B97F4A7C15 % 2**64))
                x = (x ^ (x >> turn)) * mix  # one to one
                keys.append((x ^ (x >> turn)).view(np.int64))
                of.append(fps[both])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(of))], names=["key", "fp"])


def _words(segments: pa.Array) -> np.ndarray:
    """The fingerprints as rows of eight 64-bit words."""
    return np.frombuffer(b"".join(segments.to_pylist()), "<u8").reshape(-1, SHARES // 2)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, distance) for pairs and their fingerprints (u, v, a, b): the full Hamming check."""
    for b in batches:
        distance = np.bitwise_count(_words(b.column("a")) ^ _words(b.column("b"))).sum(axis=1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(distance)], names=["u", "v", "distance"])


def _near_within(fp: np.ndarray, words: np.ndarray, linked: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near in a group, one at most for each row; its first rows, ``linked`` of them, are linked already."""
    label, ends = np.arange(len(fp)), [(np.empty(0, int), np.empty(0, int))]
    label[:linked] = 0
    for i in range(max(1, linked), len(fp)):
        hit = np.flatnonzero(np.bitwise_count(words[:i] ^ words[i]).sum(axis=1) <= DISTANCE)
        met, first = np.unique(label[hit], return_index=True)
        if len(met):
            ends.append((np.full(len(met), i), hit[first]))
            label[i] = met[0]
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    u, v = (np.concatenate(x) for x in zip(*ends))
    return fp[u], fp[v]


def _far_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): the links within each group of rows (grp, near, fp, segments) that come sorted by it, those near the group's hub first."""
    group, near, fp, words = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty((0, SHARES // 2), np.uint64)

    def flush(to: int) -> pa.RecordBatch:
        bounds = [0, *(np.flatnonzero(group[1:to] != group[: to - 1]) + 1).tolist(), to]
        found = [_near_within(fp[a:b], words[a:b], int(near[a:b].sum())) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
        ends = [np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["u", "v"])

    for b in batches:
        group = np.concatenate((group, b.column(0).to_numpy(zero_copy_only=False)))
        near = np.concatenate((near, b.column(1).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp, b.column(2).to_numpy(zero_copy_only=False)))
        words = np.concatenate((words, _words(b.column(3))))
        cut = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on in the next batch
        if cut:
            yield flush(cut)
            group, near, fp, words = group[cut:], near[cut:], fp[cut:], words[cut:]
    if len(group):
        yield flush(len(group))


def _near_links(points: DataFrame, far_block: int) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp, segments) that share a chain and are near; see ``near_text_clusters``."""
    segments = points.select("fp", "segments")
    keys = written(segments.mapInArrow(_chains, "key bigint, fp bigint"), "chains")
    # Four orders of the fingerprints: the keys of a group of copies give it few hubs, those of other groups others.
    first = F.min(F.struct(F.xxhash64(F.pmod("key", F.lit(4)), "fp").alias("h"), "fp"))["fp"]
    hubs = written(keys.groupBy("key").agg(first.alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    met = written(with_labels(keys, hubs, "key", "n").where("fp != hub"), "met")
    pairs = written(met.select("fp", "hub").distinct().join(segments, "fp").select(F.col("fp").alias("u"), F.col("hub").alias("v"), F.col("segments").alias("a")), "pairs")
    ends = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(segments.select(F.col("fp").alias("v"), F.col("segments").alias("b")), "v")
    tested = written(with_labels(pairs, written(ends, "ends"), "v", "n").select("u", "v", "a", "b").mapInArrow(_distances, "u bigint, v bigint, distance int"), "tested")
    links = tested.where(F.col("distance") <= DISTANCE).select("u", "v")
    of_hub = tested.select(F.col("u").alias("fp"), F.col("v").alias("hub"), "distance")
    far = written(met.join(of_hub.where(F.col("distance") > DISTANCE), ["fp", "hub"]).select("key", "fp", "distance"), "far")
    far_keys = written(far.groupBy("key").agg(F.count(F.lit(1)).alias("n_far"), F.min("distance").alias("least")), "far-keys")
    # What is near a hub can only be near a row that is no farther from the hub than that and DISTANCE more.
    reach = far_keys.where(F.col("least") <= 2 * DISTANCE).join(hubs.select("key", "n"), "key").select("key", "least", "n")
    close = with_labels(met, written(reach, "reach"), "key", "n").join(of_hub.where(F.col("distance") <= DISTANCE), ["fp", "hub"])
    close = written(close.where(F.col("distance") + DISTANCE >= F.col("least")).select("key", "fp"), "close")
    counts = far_keys.join(close.groupBy("key").agg(F.count(F.lit(1)).alias("n_close")), "key", "left").fillna(0, "n_close")
    blocks = [F.ceil(F.col(n) / far_block).cast("int").alias(b) for n, b in (("n_far", "far_blocks"), ("n_close", "close_blocks"))]
    many = written(counts.where("n_far + n_close > 1").select("key", (F.col("n_far") + F.col("n_close")).alias("n"), *blocks), "many")
    if many.isEmpty():
        return links
    # Every block of far rows meets every other block in a group, so none has more than two blocks of rows.
    rows = written(far.select("key", "fp", F.lit(False).alias("near")).union(close.select("key", "fp", F.lit(True))), "far-and-close")
    own = F.when(F.col("near"), F.col("far_blocks") + F.pmod(F.xxhash64("fp"), F.greatest("close_blocks", F.lit(1)))).otherwise(F.pmod(F.xxhash64("fp"), F.col("far_blocks")))
    last = F.col("far_blocks") - 1 + F.when(F.col("near"), 0).otherwise(F.col("close_blocks"))
    dealt = with_labels(rows, many, "key", "n").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.where("own != other OR far_blocks + close_blocks = 1")
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "near", "fp").join(segments, "fp").select("grp", "near", "fp", "segments")
    return links.union(dealt.repartition("grp").sortWithinPartitions("grp", F.desc("near")).mapInArrow(_far_links, "u bigint, v bigint"))


def near_text_clusters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, carry: list[str] | None = None, far_block: int = FAR_BLOCK,
) -> DataFrame:
    """(id_col, component_id, the columns in ``carry``), one row for each row of ``docs``.

    Words and shingles are those of ``simhash_clusters``, as sets. Texts are candidates when a chain of their segments
    keeps its budgets, and are linked when all 512 bits differ in DISTANCE at most (see above). Texts with the same set
    of shingles always link; so do all texts without a word. component_id is the smallest id reachable; a row with a
    null id gets a component if others in it have an id, else null. Repeated rows share their component; an empty
    table gives an empty one. Other columns are not read.

    Rows that share a key are tested against one of them, its hub, however many they are: hot keys have theirs by a
    broadcast. Rows of a key that are too far from its hub are tested against each other and against those near the
    hub that may be near them, in blocks of about ``far_block``. So all that share a key and are near are connected.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    more = {f"c{i}": c for i, c in enumerate(carry or [])}
    given = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in more.items())
    rows = written(
        docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for n, c in more.items()], F.col(text_col).cast("string").cast("binary").alias("text"))
        .mapInArrow(_text_fingerprints(width), f"id {kind}{given}, fp bigint, segments binary"),
        "text-fingerprints",
    )
    points = written(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("segments").alias("segments")), "points")
    links = _near_links(points, far_block)
    return _components_of(rows.drop("segments"), points.drop("segments"), links).select(F.col("id").alias(id_col), "component_id", *[F.col(n).alias(c) for n, c in more.items()])


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return simhash_clusters(table(spark, sf_dir, "documents"))

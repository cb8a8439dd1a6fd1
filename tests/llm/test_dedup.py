import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as index
from tessera.llm.exact_dedup import directory, exact_dedup, exact_groups
from tessera.llm.simhash import fingerprint, near_text_clusters, simhash_clusters, text_segments
from tessera.operators.graph import linked_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
DOCS = "doc_id long, text string, fp string, component_id string"


def reference_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(grams))


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus():
    rnd = random.Random(5)
    texts = [None, "", " \t\n", "One", "one", "ONE two", "É one two three", "é one two three"]
    for _ in range(25):
        base = [rnd.choice(WORDS) for _ in range(rnd.choice([5, 40, 300]))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            other[rnd.randrange(len(other))] = rnd.choice(WORDS)
            texts.append(" ".join(other).upper() if rnd.random() < 0.5 else "\x0b".join(other))
    texts.append(" ".join(rnd.choice(WORDS) for _ in range(70_000)))
    return list(enumerate(texts, 100))


def test_fingerprint_is_the_plain_one():
    for _, t in corpus()[:60]:
        assert fingerprint(None if t is None else t.encode(), 3) == reference_fingerprint(t)


def test_simhash_against_brute_force(spark):
    rows = corpus() + [(7, "one"), (None, "one"), (7, "one")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = simhash_clusters(docs).collect()
    assert len(got) == len(rows)
    fps = {i: reference_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(fps)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert len(set(want.values())) < len(ids)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 7
        else:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    assert simhash_clusters(docs.limit(0)).count() == 0


def near_copies(seed=3, n=60):
    """(texts, pairs of similarity 0.8 or more): texts of several lengths, each with copies of which some words are others."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    texts = []
    for _ in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([60, 150, 400, 1500, 6000]))]
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for _ in range(max(1, int(len(base) * rnd.uniform(0.005, 0.025)))):
                other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
            texts.append(other)
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = []
    for a in range(len(texts)):
        for b in range(a // 4 * 4, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs.append((b, a))
    return [" ".join(t) for t in texts], pairs


def near_by_definition(a, b):
    eq = (a == b) & (a != 0)
    chain = any(eq[i] and eq[(i + d) % 16] for i in range(16) for d in (1, 2, 3))
    return (a == b).all() or (chain and sum(int(x).bit_count() for x in a ^ b) <= 90)


def test_near_texts_recall_and_precision(spark):
    texts, pairs = near_copies()
    assert len(pairs) > 150
    docs = spark.createDataFrame([(i, t.upper() if i % 3 else t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r.component_id for r in near_text_clusters(docs).collect()}
    assert len(got) == len(texts)
    found = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    assert found >= 0.95, found
    direct = [text_segments(t.encode(), 5) for t in texts]
    alone = sum(near_by_definition(direct[a], direct[b]) for a, b in pairs) / len(pairs)
    assert alone >= 0.9, alone  # of single pairs, without a third text that links them
    assert all(a // 4 == b // 4 for a, b in got.items())  # unlike texts stay apart


def test_near_texts_against_their_definition(spark):
    rows = [*corpus(), (7, "one"), (None, "one"), (7, "one"), (None, "stands alone"), (8, "passage " * 30)]
    got = near_text_clusters(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS), carry=["text"]).collect()
    seg = [text_segments(None if t is None else t.encode(), 5) for _, t in rows]

    group = classes(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if near_by_definition(seg[a], seg[b])])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[group[i]] = min(d, least.get(group[i], d))
    order = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.text, r.component_id) for r in got], key=order) == sorted([(d, t, least.get(group[i])) for i, (d, t) in enumerate(rows)], key=order)
    assert near_text_clusters(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("far_block", [1024, 3])
def test_a_shared_passage_does_not_link_texts(spark, far_block):
    from tessera.llm.simhash import _chains, _near_links

    rnd = random.Random(4)
    passage = [f"common{i}" for i in range(40)]
    texts = []
    for i in range(40):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join([*own, *passage]), " ".join([*own[:-1], "changed", *passage])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_text_clusters(docs, far_block=far_block).collect()}
    assert all(v // 2 == k // 2 for k, v in got.items())
    assert sum(got[i] == i - 1 for i in range(1, 80, 2)) >= 38
    # Three groups that share whole segments, so keys with many rows that are far from their hub.
    rng, rows = np.random.default_rng(6), []
    shared = rng.integers(1, 2**32, 16, dtype=np.uint32)
    for _ in range(12):
        base = rng.integers(1, 2**32, 16, dtype=np.uint32)
        base[3:6] = shared[3:6]
        for _ in range(4):
            one = base.copy()
            for at in rng.integers(6, 16, 20):
                one[at] ^= np.uint32(1 << int(rng.integers(0, 32)))
            rows.append(one)
    points = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(rows)], "fp long, segments binary")
    links = [(r.u, r.v) for r in _near_links(points, far_block).collect()]
    assert classes(range(len(rows)), links) == classes(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if near_by_definition(rows[a], rows[b])])
    assert _near_links(points.limit(0), far_block).count() == 0
    assert points.mapInArrow(_chains, "key long, fp long").groupBy("key").count().agg({"count": "max"}).first()[0] == len(rows)


@pytest.mark.parametrize("far_block", [1024, 3])
def test_rows_near_a_hub_link_to_those_far_from_it(spark, far_block):
    from tessera.llm.simhash import _chains, _near_links

    # Lines of texts 70 bits apart, all under one key: only the neighbours in a line are near each other.
    rng, rows = np.random.default_rng(9), []
    shared = rng.integers(1, 2**32, 2, dtype=np.uint32)
    for _ in range(8):
        one = rng.integers(1, 2**32, 16, dtype=np.uint32)
        one[3:5] = shared
        for step in range(7):
            rows.append(one.copy())
            one[np.r_[0:3, 5:16]] ^= np.uint32(0b11111 << 5 * min(step, 5))
    points = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(rows)], "fp long, segments binary")
    assert points.mapInArrow(_chains, "key long, fp long").groupBy("key").count().where("count > 1").count() == 1
    links = [(r.u, r.v) for r in _near_links(points, far_block).collect()]
    assert classes(range(len(rows)), links) == {i: i // 7 * 7 for i in range(len(rows))}
    assert all(near_by_definition(rows[a], rows[b]) for a, b in links)


def test_segments_are_the_plain_ones():
    rnd = random.Random(8)
    for n in (0, 1, 4, 5, 6, 30, 900):
        words = [rnd.choice(WORDS) for _ in range(n)]
        hashes = sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(max(1, n - 4))}) if n else []
        want = []
        for s in range(16):
            least = [(h * 0x9E3779B97F4A7C15) % 2**64 >> 32 for h in hashes if h % 16 == s][:6]
            want.append(sum(1 << i for i in range(32) if 2 * sum(x >> i & 1 for x in least) > len(least)) | 1 if least else 0)
        assert text_segments(" ".join(words).encode(), 5).tolist() == want


def test_links_in_a_dense_ball_of_fingerprints(spark):
    from tessera.llm import simhash

    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = {int(c) for c in center}
    for c in center:
        for _ in range(60):
            fp.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fp = sorted(fp)
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fp]
    df = spark.createDataFrame(signed, "fp long")
    links = df.mapInArrow(simhash._keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(simhash._links(3), "u long, v long")
    rows = [(r.u % 2**64, r.v % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 40 for a, b in rows)
    want = classes(fp, [(a, b) for i, a in enumerate(fp) for b in fp[:i] if (a ^ b).bit_count() <= 3])
    assert classes(fp, rows) == want


@pytest.mark.parametrize(("bits", "most", "largest"), [(3, 10, 10_000), (3, 10, 3), (3, 0, 10_000), (2, 5, 7), (1, 5, 10_000), (0, 0, 1), (3, 1 << 14, 10_000)])
def test_large_keys_lose_no_link(spark, bits, most, largest):
    from tessera.llm import simhash

    rng = np.random.default_rng(2)
    center = [int(c) for c in rng.integers(0, 2**63, 6, dtype=np.uint64)]
    fp = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in center for _ in range(80)} | {0, 1, 2**64 - 1}
    fp = sorted(fp)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fp], "fp long")
    rows = [(r.u % 2**64, r.v % 2**64) for r in simhash.fingerprint_links(df, bits, most, largest).collect()]
    assert classes(fp, rows) == classes(fp, [(a, b) for i, a in enumerate(fp) for b in fp[:i] if (a ^ b).bit_count() <= bits])
    assert simhash.fingerprint_links(df.limit(0), bits, most, largest).count() == 0


def test_large_keys_across_batches():
    """A key that begins in one batch and goes on in others is passed on whole; its neighbours are not."""
    import pyarrow as pa

    from tessera.llm import simhash

    key = [1] * 3 + [2] * 40 + [3] * 2 + [4] * 9 + [5] * 30
    fp = list(range(len(key)))
    for step in (1, 4, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + step], pa.int64()), pa.array(fp[i : i + step], pa.int64())], names=["key", "fp"]) for i in range(0, len(key), step)]
        on = sorted(r["u"] for b in simhash._links(3, 8)(iter(batches)) for r in b.to_pylist() if r["v"] is None)
        assert on == [f for k, f in zip(key, fp, strict=True) if k in (2, 4, 5)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 10), (5, 5), (None, 1)] + [(50, i) for i in range(60, 200)] + [(i, i + 1) for i in range(300, 400)]
    got = {r.node: r.root for r in linked_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = classes({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert {k: v for k, v in want.items() if k in got} == got
    assert set(want) - set(got) <= {5}
    assert linked_components(spark.createDataFrame([], "u long, v long")).count() == 0


EXACT = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x"), (7, "x"), (None, "x"), (None, "q"), (None, "Q"), (9, " a b")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in EXACT], "doc_id long, text string, keep_id int, kept string")
    more = {"key": lambda c: F.length(c), "digest": lambda c: F.length(c) % 2, "capacity": 1} if weak else {}
    got = exact_groups(docs, **more).collect()
    assert len(got) == len(EXACT)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append((r.doc_id, r.keep_id, r.group_size, r.kept))
    assert sorted(map(sorted, (v for v in by.values() if len(v) == 2 and v[0][0] is not None))) == [
        [(1, 2, 2, False), (2, 2, 2, True)], [(5, 6, 2, False), (6, 6, 2, True)]]
    assert sorted((x for v in by.values() for x in v if x[1] == 7), key=str) == [(7, 7, 3, True), (7, 7, 3, True), (None, 7, 3, False)]
    assert sum(x[3] for v in by.values() for x in v) == 9
    kept = exact_dedup(docs).collect()
    assert sorted((r.text or "").lower() for r in kept) == sorted(["a b", "É".lower(), "é", "", "x", "q", " a b"])
    assert exact_groups(docs.limit(0)).count() == 0 and exact_dedup(docs.limit(0)).count() == 0


def test_directory_doubles(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    slots, depth = directory(keys, 70)
    rows = slots.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(1 << depth)) and max(r.depth for r in rows) == depth
    # A bucket is all slots that share its first bits; those of less depth than the directory have several.
    assert all(r.bucket == r.slot >> (depth - r.depth) << 8 | r.depth for r in rows) and len({r.depth for r in rows}) > 1
    sizes = {r.bucket: r["count"] for r in index.with_bucket(keys, slots, depth, 1 << 20).groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 5000 and max(sizes.values()) <= 70
    for b in sizes:  # no split was in vain: a bucket and its sibling together are too full
        d, bits = b & 255, b >> 8
        inside = [n for o, n in sizes.items() if (o & 255) >= d and (o >> 8) >> ((o & 255) - d) in (bits, bits ^ 1)]
        assert d == 0 or sum(inside) > 70
    few, depth = directory(keys.limit(3), 4)
    assert depth == 0 and [(r.slot, r.bucket) for r in few.collect()] == [(0, 0)]
    # keys that share their first 40 bits: no largest depth stops the doubling of what can still be split
    assert directory(spark.range(4).select((F.col("id") * (1 << 54)).alias("h")), 1)[1] == 10


@pytest.mark.parametrize(("broadcast", "shares"), [(1 << 20, 10_000), (0, 10_000), (1 << 20, 1)])
def test_owners_have_whole_buckets(spark, broadcast, shares):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), (F.col("id") % 700).cast("string")).alias("text"))
    rows, entries, _ = index.build_index(docs, capacity=20, max_broadcast=broadcast, hot_shares=shares)
    at = {}
    for r in entries.select("bucket", "h", "group_size", F.input_file_name().alias("file")).collect():
        at.setdefault(r.bucket, []).append(r)
    assert len(at) > 30 and all(len({x.h for x in v}) <= 20 for v in at.values()) and sum(len(v) for v in at.values()) == 700
    if shares == 1:  # nothing is hot: each bucket lies in the one file of its owner
        assert all(len({x.file for x in v}) == 1 for v in at.values())
    got = exact_groups(docs, capacity=20, max_broadcast=broadcast, hot_shares=shares).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {
        (i, i + 700 * ((1999 - i) // 700), len(range(i % 700, 2000, 700))) for i in range(2000)}


def test_rows_are_found_through_the_directory_only(spark, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    whole = index.directory

    def half(keys, capacity):
        slots, depth = whole(keys, capacity)
        return slots.where("slot % 2 = 0"), depth

    monkeypatch.setattr(index, "directory", half)
    assert 0 < exact_groups(docs, capacity=20).count() < 500


def test_a_hot_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.col("id").cast("string")).alias("text"))
    assert exact_dedup(docs).count() == 2001
    one = simhash_clusters(docs).where("component_id = 0").count()
    assert one >= 1000


def test_labels_reach_hot_and_rare_keys(spark):
    from tessera.llm.common import with_labels

    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_000).alias("fp"), F.lit("x").alias("extra"))
    labels = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")).withColumn("label", F.col("fp") * 2)
    got = with_labels(rows, labels, "fp", "copies")
    assert got.columns == ["fp", "id", "extra", "label"]
    assert got.where("label = fp * 2").count() == 30_000 == got.select("id").distinct().count()
    assert with_labels(rows.limit(0), labels.limit(0), "fp", "copies").count() == 0

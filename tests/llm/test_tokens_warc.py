import base64
import gzip
import hashlib
import io
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, token_cache, warc
from tessera.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "<|endoftext|>a<|endoftext|>", " \x1c \x85　x", "a" * 300, " " * 50 + "x", "日本語テキスト 😀x", "don't I'LL we've", "\r\n\n\t a", "ab" * 200_000]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(coder, texts):
    parts = [b""] * len(texts)
    for i, x in coder.encode_blocks(texts):
        parts[i] += x
    return [np.frombuffer(p, "<u4").tolist() for p in parts]


def test_encoding_is_the_librarys(library, spark, sf):
    coder = bpe.Bpe(PATH)
    rnd = random.Random(7)
    alpha = ["a", "b", " ", "  ", "\n", "é", "1", "!", "'s", "'", "<|endoftext|>", "\x1c", "\xa0", "漢", "😀", "th", "ing", "\x00", "²", "​"]
    texts = ODD + ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert ids_of(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < coder.failed < coder.proposed  # both ways are taken


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_comes_back(text):
    coder = bpe.load(PATH)
    ids = np.array(ids_of(coder, [text])[0], "<u4").tobytes()
    assert coder.decode(ids).decode() == text


def test_digests_and_round_trip(spark, library):
    texts = [*ODD, None, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode_decode_digests(docs, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        r = got[i if i else None]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    again = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert again == {(i if i else None): t or "" for i, t in enumerate(texts)}
    assert bpe.encode_decode_digests(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_and_their_cache(spark, name):
    path = public_tokenizers.path(name)
    texts = [*ODD[:-1], None, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, content int")
    count = token_cache.counter(path)
    cache = scratch(spark, "cache")
    for _ in range(2):
        got = token_cache.count_tokens(docs, path, cache, limit=20).collect()
        assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
            (i if i else None, len((t or "").encode()), n, n > 20) for (i, t), n in zip(enumerate(texts), count([t or "" for t in texts]))}
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    more = docs.union(spark.createDataFrame([(99, "quite new", 1)], docs.schema))
    assert token_cache.count_tokens(more, path, cache).count() == len(texts) + 1
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1
    assert token_cache.count_tokens(docs.limit(0), path, scratch(spark, "cache")).count() == 0


def test_counting_is_the_librarys_plain_encoding(library):
    assert token_cache.counter(PATH)(ODD) == [len(library.encode(t, add_special_tokens=False).ids) for t in ODD]


PAGES = [
    (1, "http://a", "x" * 1500), (2, None, "x" * 1500), (3, "http://c\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (None, "u", ""), (None, "u", "x" * 1500),
    (7, "u", "é" * 500), (6, "u", "é" * 500), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60), (9, "u", "y" * 999), (10, "u", "y" * 999), (7, "u", "é" * 500),
]


@pytest.mark.parametrize("span", [7, 100, 1 << 20])
def test_warc_round_trip(spark, span):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")
    manifest = warc.write_warc(pages.coalesce(2), scratch(spark, "warc"))
    got = warc.read_warc(manifest, span=span).collect()
    best = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        refers = best.get(h) if best.get(h) not in (None, i) else None
        want.append((str(i) if i is not None else None, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", str(refers) if refers else None, None if refers else data))
    order = lambda x: tuple(map(str, x))
    assert sorted([(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], key=order) == sorted(want, key=order)
    assert warc.read_warc(warc.write_warc(pages.limit(0), scratch(spark, "warc"))).count() == 0


@pytest.mark.parametrize("shares", [0, 10_000, 10**9])
def test_warc_copies_hot_and_rare(spark, monkeypatch, shares):
    """Decisions by broadcast and by shuffle are the same (0: no copy is hot)."""
    monkeypatch.setattr(warc, "HOT_SHARES", shares)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.lit("body "), (F.col("id") % 90).cast("string")), 200).alias("html"))
    got = warc.read_warc(warc.write_warc(pages, scratch(spark, "warc")), content=False).collect()
    assert {(int(r.page), r.refers_to) for r in got} == {(i, None if i + 90 >= 400 else str(i + 90 * ((399 - i) // 90))) for i in range(400)}
    assert len(got) == 400


def test_no_record_is_lost_whatever_its_header(spark):
    """Addresses of a megabyte that don't compress, at many places of the reading steps."""
    rnd = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
    data, places = b"", []
    for i in range(50):
        url = "".join(rnd.choices(alphabet, k=1_000_000 if i % 10 == 0 else 150_000))
        filler = rnd.randbytes(rnd.randrange(50_000))
        for u, body in ((None, filler), (url, b"x")):
            packer = zlib.compressobj(warc.LEVEL, zlib.DEFLATED, 31)
            places.append(len(data))
            data += packer.compress(warc.record(str(i), u, body, hashlib.sha1(body).hexdigest(), None)) + packer.flush()
    for span in (100_000, 1 << 20, 1 << 30):
        seen = [at for s in range(0, len(data), span) for at, _ in warc.records(io.BytesIO(data), s, min(s + span, len(data)))]
        assert seen == places
    pages = spark.createDataFrame([(i, "".join(rnd.choices(alphabet, k=600_000)), "page") for i in range(3)], "page_id long, url string, html string")
    got = warc.read_warc(warc.write_warc(pages, scratch(spark, "warc")), span=100_000)
    assert {(r.page, r.url) for r in got.collect()} == {(str(r.page_id), r.url) for r in pages.collect()}


def test_a_large_record_takes_linear_time():
    rnd, took = random.Random(7), []
    for size in (16 << 20, 64 << 20):
        body = rnd.randbytes(size)
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        data = packer.compress(warc.record("1", None, body, hashlib.sha1(body).hexdigest(), None)) + packer.flush()
        began = time.process_time()
        (_, got), = warc.records(io.BytesIO(data), 0, len(data))
        assert warc.parsed(got)["payload"] == body
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_a_damaged_file_is_an_error(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    manifest = warc.write_warc(pages.coalesce(1), scratch(spark, "warc"))
    path = manifest.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    middle = data.index(warc.MAGIC, len(data) // 2)
    with open(path, "wb") as f:
        f.write(data[:middle] + bytes(40) + data[middle + 40 :])
    with pytest.raises(ValueError, match="49 records read of 50"):
        warc.read_warc(manifest)
    assert warc.read_warc(manifest.select("path", "size")).count() == 49


def test_files_are_plain_gzip(spark):
    pages = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string")
    path = warc.write_warc(pages, scratch(spark, "warc")).first().path
    text = gzip.decompress(open(path.removeprefix("file://"), "rb").read())
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"hello\r\n\r\n")
    assert base64.b32encode(hashlib.sha1(b"hello").digest()) in text


def test_magic_inside_a_record_begins_none():
    rnd = random.Random(4)
    decoy = gzip.compress(b"no record") + warc.MAGIC + b"junk" + gzip.compress(b"WARC/1.1\r\nno length\r\n\r\n")
    places, data = [], b""
    for i in range(40):
        body = rnd.randbytes(rnd.randint(0, 4000)) + decoy * rnd.randint(0, 2)
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the decoys stand in the file as they are
        places.append(len(data))
        data += packer.compress(warc.record(str(i), None, body, hashlib.sha1(body).hexdigest(), None)) + packer.flush()
    for span in (50, 999, 10**7):
        seen = [at for s in range(0, len(data), span) for at, _ in warc.records(io.BytesIO(data), s, min(s + span, len(data)))]
        assert seen == places


def test_op10_equals_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = sorted(con.execute(warc.OP10_SQL).fetchall())
    assert sorted(tuple(r) for r in warc.op10_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_cached_frames_need_no_more(spark, sf):
    assert token_cache.op9_token_counts(spark, sf).where(F.col("n_tokens") > 0).count() > 0

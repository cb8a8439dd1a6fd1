"""WARC archives: written by tasks, read back by a splittable reader.

Each record is a gzip member of its own. A reading task takes a byte range, looks for gzip
magic, and accepts a candidate only if it inflates to a header that begins with the WARC
version and holds a length; a header may be of any length. It owns the records that *begin*
in its range, and reads on past its end to finish the last one. The records read from each
file are counted and held against the manifest: none is lost without an error.

Equal payloads are found on narrow rows. Pages whose payload surely is no copy, and copies of
hot payloads, are written where they are; only the other copies meet their decision by a
shuffle. At every input size the broadcast tables hold at most 2^18 words of a bitmap of
copied digests and the decisions on HOT_SHARES hot ones.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT_SHARES, scratch, ship, table, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes read at a time; length of a range.
STEP, RANGE = 1 << 18, 8 << 20
LEVEL = 4
#: Equal payloads of so many bytes are written once.
LEAST = 1000
#: Bits of the bitmap of copied digests: it has 2^(BITMAP - 6) words at most.
BITMAP = 24
CRLF = b"\r\n"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def clean(value: str) -> str:
    """A header's value has no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit has the response's headers without its payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + CRLF + CRLF


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        out, path, size, n = None, "", 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                # The name is new for each attempt: of a task that ran twice only one file is in the manifest.
                fs.create_dir(at, recursive=True)
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(opened(path)[1], compression=None)
            for page, url, payload, refers in zip(*(b.column(c) for c in ("page", "url", "payload", "refers_to")), strict=True):
                data = payload.as_py() or b""
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record(page.as_py(), url.as_py(), data, hashlib.sha1(data).hexdigest(), refers.as_py())) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "records"])

    return run


def headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class Source:
    """Bytes of a file from a place on, read in steps; what lies before the place asked for is let go."""

    def __init__(self, stream, start: int):
        self.stream, self.start, self.data, self.over = stream, start, bytearray(), False
        stream.seek(start)

    def more(self) -> bool:
        got = b"" if self.over else self.stream.read(STEP)
        self.over = self.over or not got
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[: to - self.start]
        self.start = to


def member(source: Source, at: int) -> tuple[bytearray, int] | None:
    """(whole record, place after its member) if a record begins at ``at``, else None."""
    unpack = zlib.decompressobj(31)
    out, taken, looked, checked = bytearray(), at, 0, False
    while True:
        piece = bytes(source.data[taken - source.start : taken - source.start + STEP])
        if not piece:
            if not source.more():
                return None
            continue
        try:
            out += unpack.decompress(piece)
        except zlib.error:
            return None
        taken += len(piece)
        if not checked:
            if not b"WARC/1.".startswith(out[:7]):
                return None
            end = out.find(b"\r\n\r\n", looked)
            looked = max(0, len(out) - 3)
            if end >= 0:
                if not headers(bytes(out[:end])).get("content-length", "").isdigit():
                    return None
                checked = True
        if unpack.eof:
            return (out, taken - len(unpack.unused_data)) if checked else None


def records(stream, start: int, end: int) -> Iterator[tuple[int, bytearray]]:
    """(place, record) of the records that begin in [start, end)."""
    source, at = Source(stream, start), start
    while at < end:
        while len(source.data) - (at - source.start) < len(MAGIC) and source.more():
            pass
        found = source.data.find(MAGIC, at - source.start)
        if found < 0:
            at = max(at, source.start + len(source.data) - len(MAGIC) + 1)
            source.drop(at)
            if at >= end or not source.more():
                return
            continue
        at = source.start + found
        if at >= end:
            return
        source.drop(at)
        got = member(source, at)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]
        source.drop(at)


def parsed(data: bytearray) -> dict:
    """Type, page, payload and what refers to it; payload is None for a revisit."""
    begin = data.find(b"\r\n\r\n") + 4
    fields = headers(bytes(data[: begin - 4]))
    stop = begin + int(fields["content-length"])
    body = data.find(b"\r\n\r\n", begin, stop)
    http, payload = (bytes(data[begin:stop]), b"") if body < 0 else (bytes(data[begin:body]), bytes(data[body + 4 : stop]))
    digest = fields.get("warc-payload-digest", "")
    kind = fields.get("warc-type", "")
    refers = fields.get("warc-refers-to", "")
    return {
        "page": fields.get("x-page-id"), "url": fields.get("warc-target-uri"), "type": kind,
        "payload": None if kind == "revisit" else payload,
        "bytes": int(headers(http).get("content-length", "0")) if kind == "revisit" else len(payload),
        "digest": base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None,
        "refers_to": refers[len("<urn:page:") : -1] if refers.startswith("<urn:page:") else None,
    }


def _read(content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                fs, at = opened(path)
                rows: list[tuple] = []
                size = 0
                with fs.open_input_file(at) as stream:
                    for _, data in records(stream, start, end):
                        r = parsed(data)
                        digest = r["digest"] if r["payload"] is None else hashlib.sha1(r["payload"]).hexdigest()
                        if r["digest"] not in (None, digest):
                            raise ValueError(f"{path}: a payload isn't the one that was written")
                        rows.append((path, r["page"], r["url"], r["bytes"], digest, r["type"], r["refers_to"], r["payload"] if content else None))
                        size += len(data) if content else 300
                        if size > 8 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return run


READ = "path string, page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row; return the manifest (path, size, records), which is written too.

    Of equal payloads of at least 1000 bytes the row with the largest id is a response and
    the others revisit it; rows repeated under that id are responses too, and so are rows
    without an id where no row of the payload has one. A null page counts as empty.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    copied = keyed.where(F.col("size") >= LEAST).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = written(copied.where("n > 1 AND first IS NOT NULL").withColumn("hot", F.col("n") * HOT_SHARES > pages.select(F.lit(1)).count()), "copied")
    bit = F.conv(F.substring("sha", 1, BITMAP // 4), 16, 10).cast("long")
    word, place = F.shiftright(bit, 6).alias("word"), bit % 64
    # A bit is set where some digest with these first digits has copies; unset bits tell that a payload has none.
    bits = copied.where("NOT hot").groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(conv(substring(sha, 1, %d), 16, 10) AS bigint) %% 64)" % (BITMAP // 4))).alias("bits"))
    told = (
        keyed.withColumn("word", word).join(F.broadcast(bits), "word", "left")
        .join(F.broadcast(copied.where("hot").select("sha", F.col("first").alias("hot_first"))), "sha", "left")
        .withColumn("unsure", F.col("hot_first").isNull() & (F.col("size") >= LEAST) & (F.coalesce(F.getbit(F.col("bits"), place.cast("int")), F.lit(0)) == 1))
        .withColumn("hot_first", F.when(F.col("size") >= LEAST, F.col("hot_first")))
    )
    here = told.where("NOT unsure").select("id", "url", "payload", F.col("hot_first").alias("first"))
    met = told.where("unsure").join(copied.where("NOT hot").select("sha", "first"), "sha", "left").select("id", "url", "payload", "first")
    chosen = here.union(met).select(
        F.col("id").cast("string").alias("page"), "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"))
    return written(chosen.mapInArrow(_write(folder), "path string, size long, records long"), "manifest")


def read_warc(manifest: DataFrame, content: bool = True, span: int = RANGE) -> DataFrame:
    """The records of the files (path, size) of a manifest; the payload of a revisit is null, and any is without ``content``.

    What was read is written in the shared folder. Where the manifest has the column records, a file of
    which another number of records was read, as of a damaged one, is an error. An empty manifest gives an empty table.
    """
    ship(manifest.sparkSession)
    ranges = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + span, "size").alias("end"))
    n = max(1, ranges.count())
    read = written(ranges.repartition(n).mapInArrow(_read(content), READ), "records")
    if "records" in manifest.columns:
        seen = read.groupBy("path").agg(F.count(F.lit(1)).alias("seen"))
        off = manifest.select("path", "records").join(seen, "path", "left").where(F.coalesce("seen", F.lit(0)) != F.col("records")).first()
        if off:
            raise ValueError(f"{off['path']}: {off['seen'] or 0} records read of {off['records']}")
    return read.drop("path")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_warc(manifest, content=False).select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest AS pd, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN g ON pd = payload_digest AND payload_bytes >= 1000
"""

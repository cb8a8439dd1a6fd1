"""Byte-pair encoding by speculation: greedy longest matches, verified pair by pair.

A sequence of tokens is the encoding of its bytes if every two neighbours are the encoding
of theirs. So greedy longest matches are proposed for all new words of a block, all their
neighbours are tested at once against the pairs known so far, and only words that hold a
pair that fails are merged by rank.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table

#: Fixed value: the pattern that byte-level vocabularies of this kind split texts by; white space is the Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Words whose tokens are remembered (at most two such sets and a block's words); pairs that are
#: remembered (so many and a block's); bytes of words that are merged without a heap; characters of
#: texts in a block.
CACHE, PAIRS, SHORT, CHARS = 200_000, 1 << 22, 64, 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token: list[bytes] = [b""] * (1 + max(chain(vocab.values(), self.special.values())))
        for t, i in vocab.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.vocab = vocab
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        sizes: dict[bytes, set[int]] = {}  # lengths that tokens have, by their first three bytes
        for t in vocab:
            sizes.setdefault(t[:3], set()).add(len(t))
        for k in sizes:
            for short in (k[:1], k[:2]):
                if short in vocab:
                    sizes[k].add(len(short))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        self.own: dict[int, bool] = {}
        self.codes = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.failed = self.proposed = 0
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """The exact encoding: merges by rank, the leftmost first."""
        ids, n = [self.single[b] for b in data], len(data)
        if n <= SHORT:
            return self._merge_short(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*self.rank[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heap = [(r, i, m, p) for r, m, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, m, pair = heapq.heappop(heap)
            j = right[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = m, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and (b := right[a]) < n and (p := (ids[a], ids[b])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], a, self.rank[p][1], p))
        return [i for i in ids if i >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """For few bytes it takes less time to look through all pairs again than to keep a heap."""
        get, none = self.rank.get, (1 << 60, 0)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                return ids
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def propose(self, data: bytes) -> list[int]:
        """The longest tokens from left to right, of those that are the encoding of their own bytes."""
        out, at, n, vocab, sizes, own = [], 0, len(data), self.vocab, self.sizes, self.own
        while at < n:
            for size in sizes.get(data[at : at + 3]) or sizes.get(data[at : at + 2]) or ():
                t = vocab.get(data[at : at + size]) if at + size <= n else None
                if t is not None and (own[t] if t in own else self._own(t)):
                    break
            else:
                t, size = self.single[data[at]], 1
            out.append(t)
            at += size
        return out

    def _own(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self.merge(self.token[token]) == [token]
        return known

    def _compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair (a << 20 | b) is the encoding of its bytes."""
        if len(self.codes) > PAIRS:
            self.codes, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        new = np.unique(codes)
        if len(self.codes):
            new = new[self.codes[np.minimum(np.searchsorted(self.codes, new), len(self.codes) - 1)] != new]
        if len(new):
            good = np.fromiter((self.merge(self.token[c >> 20] + self.token[c & 0xFFFFF]) == [c >> 20, c & 0xFFFFF] for c in new.tolist()), bool, len(new))
            at = np.searchsorted(self.codes, new)
            self.codes, self.fits = np.insert(self.codes, at, new), np.insert(self.fits, at, good)
        return self.fits[np.searchsorted(self.codes, codes)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        data = [w.encode("utf-8", "replace") for w in words]
        guess = [self.propose(d) for d in data]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        ids = np.fromiter(chain.from_iterable(guess), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(guess)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        bad = set(word[inner[~self._compatible((ids[inner] << 20) | ids[inner + 1])]].tolist())
        self.failed += len(bad)
        self.proposed += len(words)
        return [np.array(self.merge(d) if i in bad else g, "<u4").tobytes() for i, (d, g) in enumerate(zip(data, guess, strict=True))]

    def encode_blocks(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(which text, some of its ids) in order; a very long text comes in several parts."""
        pending: list[tuple[int, list[str] | bytes]] = []
        held = 0

        def flush() -> Iterator[tuple[int, bytes]]:
            if len(self.known) > CACHE:  # words that are met again come over from the older ones
                self.older, self.known = self.known, {}
            known = self.known
            fresh = []
            for w in {w for _, part in pending if isinstance(part, list) for w in part} - known.keys():
                if (ids := self.older.get(w)) is None:
                    fresh.append(w)
                else:
                    known[w] = ids
            known.update(zip(fresh, self.encode_words(fresh), strict=True))
            for i, part in pending:
                yield i, b"".join(map(known.__getitem__, part)) if isinstance(part, list) else part
            pending.clear()

        for i, text in enumerate(texts):
            for piece in self.split.split(text) if self.split else [text]:
                if piece in self.special:
                    pending.append((i, self.special[piece].to_bytes(4, "little")))
                    continue
                found = (m[0] for m in self.words.finditer(piece)) if len(piece) > CHARS else iter(self.words.findall(piece))
                while part := list(islice(found, CHARS // 4)):
                    pending.append((i, part))
                    held += len(part) * 5
                    if held > CHARS:
                        yield from flush()
                        held = 0
        yield from flush()

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def load(path: str) -> Bpe:
    """The encoder for a file, made once for each Python worker."""
    made = load.__dict__.setdefault("made", {})
    if path not in made:
        made[path] = Bpe(path)
    return made[path]


class _Digest:
    """Of one text: number of ids, digest of ids, digest of the decoded text."""

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: bytes, data: bytes, last: bool = False) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.text.update(self.utf8.decode(data, last).encode())


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [_Digest() for _ in texts]
            for i, ids in bpe.encode_blocks([t or "" for t in texts]):
                out[i].add(ids, bpe.decode(ids))
            for d in out:
                d.add(b"", b"", True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([d.n for d in out], pa.int64()), pa.array([d.ids.hexdigest() for d in out], pa.string()), pa.array([d.text.hexdigest() for d in out], pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _token_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            parts: list[list[bytes]] = [[] for _ in texts]
            for i, ids in bpe.encode_blocks([t or "" for t in texts]):
                parts[i].append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def _mapped(rows: DataFrame, id_col: str, col: str, kind_of: str, function, more: str) -> DataFrame:
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(col).cast(kind_of).alias("x")).mapInArrow(function, f"id {kind}, {more}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>), one row for each row; null texts count as empty, which have no id."""
    return _mapped(docs, id_col, text_col, "string", _token_ids(path), "ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text), one row for each row; a null list counts as empty. Bytes that aren't UTF-8 become U+FFFD."""
    return _mapped(rows, id_col, ids_col, "array<int>", _texts(path), "text string")


def encode_decode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256), one row for each row of ``docs``.

    Special strings in a text become their own ids, as the library does by default. Null
    texts count as empty: no token, digests of nothing. Very long texts are encoded in parts
    of bounded size; repeated rows and null ids have a row each; an empty table gives an
    empty one. Other columns are not read.
    """
    return _mapped(docs, id_col, text_col, "string", _encoded(path), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

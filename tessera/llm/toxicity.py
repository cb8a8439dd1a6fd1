"""Toxicity by a learned lexicon, matched with Levenshtein automata along a trie.

The lexicon is learned from labelled rows: a term must stand in toxic texts in more
*different contexts* (the word before it) than chance allows, so the words of a text that
was copied many times don't become terms. Misspelled terms are found by running the
Levenshtein automaton of each word (sparse states: trie node, place, edits) over the trie.
Each hit is weighed by its window: between quotation marks or after words that report
speech it counts less than in open abuse.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table, written

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that the lexicon is learned from; it holds all of their terms.
MAX_LABELLED = 12_000
#: Share of a term's weight that a misspelling of it has before any is seen, and that a quoted
#: hit has; the threshold of a prediction.
MISSPELLED, QUOTED, THRESHOLD = 0.5, 0.5, 0.7
#: Where misspellings of a term stand in toxic texts less often than this, they don't count.
LEAST_SHARE = 0.3
WINDOW = 40
CACHE = 200_000
OPENING, CLOSING = "\"“„«‘'‹", "\"”“»’'›"
REPORTING = frozenset("said says quote quoted quoting called calls wrote writes word term dijo dice dit sagte nannte genannt citation zitat cita".split())


class Trie:
    """The lexicon; automaton(word) gives the term within the allowed edits that weighs most."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.root: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.middles: dict[int, set[str]] = {}
        self.sizes: set[int] = set()
        for t in terms:
            if edits(t):
                self.sizes.update(range(len(t) - edits(t), len(t) + edits(t) + 1))
                # Of 1 + k parts of a term, k edits leave one whole. The first then begins the word and the last
                # ends it; where k = 2, the middle third may stand up to two places off.
                half = len(t) // 2 if edits(t) == 1 else len(t) // 3
                self.heads.add(t[:half][:3])
                self.tails.add(t[half if edits(t) == 1 else -half:][-3:])
                if edits(t) == 2:
                    for at in range(half - 2, half + 3):
                        self.middles.setdefault(at, set()).add(t[half : half + 3])
            node = self.root
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = t

    def near(self, word: str) -> tuple[str, int] | None:
        """(term, edits) for the heaviest of the terms within their allowed edits, 1 or more."""
        if len(word) not in self.sizes or not (
            word[:3] in self.heads or word[:2] in self.heads or word[-3:] in self.tails or word[-2:] in self.tails
            or any(word[at : at + 3] in m for at, m in self.middles.items())
        ):
            return None
        best: tuple[float, str, int] | None = None
        stack = [(self.root, tuple((i, i) for i in range(3)))]  # states: (place in the word, edits)
        n = len(word)
        while stack:
            node, states = stack.pop()
            if "" in node:
                term = node[""]
                done = min((e + n - i for i, e in states if e + n - i <= 2), default=9)
                if 0 < done <= edits(term) and (best is None or self.terms[term] > best[0]):
                    best = (self.terms[term], term, done)
            for ch, below in node.items():
                if ch == "":
                    continue
                new: dict[int, int] = {}
                for i, e in states:
                    if i < n and word[i] == ch:
                        new[i + 1] = min(e, new.get(i + 1, 9))
                    if e < 2:
                        new[i] = min(e + 1, new.get(i, 9))  # a letter of the term is left out
                        if i < n:
                            new[i + 1] = min(e + 1, new.get(i + 1, 9))
                for i in sorted(new):  # letters of the word that are too many
                    if i < n and new[i] < 2:
                        new[i + 1] = min(new[i] + 1, new.get(i + 1, 9))
                if new:
                    stack.append((below, tuple(sorted(new.items()))))
        return best and best[1:]


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """terms: weight of each; spelled: weight of a misspelling of it."""

    terms: dict[str, float]
    spelled: dict[str, float]


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.trie = Trie(lexicon.terms)
        self.spelled = lexicon.spelled
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """0 for a word that is no term and near to none."""
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            w = self.trie.terms.get(word, 0.0)
            if not w and (found := self.trie.near(word)):
                w = self.spelled.get(found[0], 0.0)
            self.known[word] = w
        return w

    def score(self, text: str | None) -> float:
        """1 - product of (1 - weight) over the hits, each weighed by its window."""
        lower = (text or "").lower()
        known, weight = self.known, self.weight
        hits = {w for w in set(WORD.findall(lower)) if (known[w] if w in known else weight(w))}
        if not hits:
            return 0.0
        rest = 1.0
        for m in WORD.finditer(lower):
            if m[0] in hits:
                rest *= 1.0 - weight(m[0]) * (QUOTED if quoted(lower, m.start(), m.end()) else 1.0)
                if rest < 1e-9:
                    break
        return 1.0 - rest


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit reads as a quotation."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    opened = max(before.rfind(q) for q in OPENING)
    shut = min((i for q in CLOSING if (i := after.find(q)) >= 0), default=-1)
    if opened >= 0 and shut >= 0 and "\n" not in before[opened:] and "\n" not in after[:shut] and before[opened - 1 : opened].strip() == "":
        return True
    return bool(REPORTING.intersection(WORD.findall(before)[-3:]))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, word before it, toxic) for the distinct words of each text."""
    for b in batches:
        words, before, toxic = [], [], []
        for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            own = WORD.findall((text.as_py() or "").lower())
            first = dict(zip(reversed(own), reversed(["", *own[:-1]]), strict=True))
            words += first
            before += first.values()
            toxic += [y] * len(first)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.int32())], names=["word", "before", "toxic"])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED,
) -> Lexicon:
    """From at most ``max_labelled`` labelled rows that are not held out.

    The rows are those with the least hash of their id. The weight of a term is the smoothed
    share of toxic texts among those that hold it. Words near to a term that are none
    themselves tell what a misspelling of it weighs. Labels that are empty or all alike give
    an empty lexicon.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(id_col)))
        .select(F.col(id_col).alias("i"), F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("i"), "i").limit(max_labelled).collect()
    )  # at most max_labelled pairs of integers
    if not chosen:
        return Lexicon({}, {})
    sample = spark.createDataFrame(chosen, labels.select(F.col(id_col).alias("i"), F.col("toxic").cast("int").alias("toxic")).schema).dropDuplicates(["i"])
    base = sum(r["toxic"] for r in chosen) / len(chosen)
    if not 0 < base < 1:
        return Lexicon({}, {})
    words = (
        docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "i").select("text", "toxic")
        .mapInArrow(_evidence, "word string, before string, toxic int")
    )
    pairs = words.groupBy("word", "before").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    found = pairs.groupBy("word").agg(
        F.count_if(F.col("bad") > 0).alias("contexts"), F.sum("bad").alias("bad"), (F.sum("n") - F.sum("bad")).alias("good"))
    found = written(found, "words")
    n_words = found.where("contexts > 1").count()
    # So many contexts, all toxic by chance, are expected for less than one word in e^2 lexicons.
    least = (math.log(max(2, n_words)) + 2) / -math.log(base)
    weight = (F.col("contexts") + 2 * base) / (F.col("contexts") + F.col("good") + 2)
    rows = found.where(F.col("contexts") >= least).withColumn("w", weight).where("w >= 0.75")
    terms = {r["word"]: min(0.99, float(r["w"])) for r in rows.select("word", "w").collect()}
    if not terms:
        return Lexicon({}, {})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(terms)
        for b in batches:
            hits = [None if w in terms else trie.near(w) for w in b.column(0).to_pylist()]
            at = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in hits if h], pa.string()), b.column(1).take(at), b.column(2).take(at)], names=["term", "bad", "good"])

    seen = {r["term"]: (r["bad"], r["good"]) for r in found.select("word", "bad", "good").mapInArrow(near, "term string, bad long, good long")
            .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}  # a row for each term at most
    spelled = {}
    for t, w in terms.items():
        bad, good = seen.get(t, (0, 0))
        share = (bad + MISSPELLED) / (bad + good + 1)
        spelled[t] = w * share if share >= LEAST_SHARE else 0.0
    return Lexicon(terms, spelled)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, score, predicted), one row for each row of ``docs``.

    Null and empty texts score 0. Repeated rows and null ids have a row each; ties don't
    arise; an empty table gives an empty one. Other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["id", "score"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
        .select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

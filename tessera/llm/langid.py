"""Language identification by fusing evidence.

log P(l | page) = text + declared + suffix + host + constant:
text      log-likelihoods of hashed byte trigrams, learned from a bounded sample of labelled texts
declared  P(declared language | l), learned by grouped aggregation and smoothed
suffix    P(address suffix | l), smoothed towards P(suffix)
host      P(l | host), smoothed towards its domain, and that towards all pages
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table, with_labels, written
from tessera.llm.html_text import page_language, parse, render_tree

BUCKETS = 1 << 14
#: Labelled texts that the model is learned from; it knows all their languages.
MAX_LABELLED = 3_000
#: Trigrams of one text are not independent: the mean over all of them counts as that of so many at most.
TEXT_WEIGHT, TEXT_MOST = 0.2, 400
KAPPA = 5.0
BLOCK = 1 << 20


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # bucket x language

    @cached_property
    def gaps(self) -> np.ndarray:
        """[a, b]: by how much a trigram of a text in a is likelier in a than in b, in logarithms, on average."""
        p = np.exp(self.logp)
        return (p * self.logp).sum(axis=0)[:, None] - p.T @ self.logp


def histogram(text: str | None) -> np.ndarray:
    """Counts of the hashed byte trigrams of the letters; runs of anything else are one space."""
    counts = np.zeros(BUCKETS, np.int64)
    data = (text or "").lower().encode("utf-8", "replace")
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
        b = np.where((b >= 97) & (b <= 122) | (b >= 128), b, 32).astype(np.uint32)
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
        if len(b) > 2:
            gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            h = histogram(text.as_py())
            total[lang] = total[lang] + h if lang in total else h
    for lang, h in total.items():
        at = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(h[at], pa.int64())], names=["lang", "gram", "n"])


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_labelled: int = MAX_LABELLED) -> Model:
    """From the whole texts of at most ``max_labelled`` labelled rows, those with the least hash of their id.

    Rows without a label or id are passed over; no labelled row gives a model that knows no
    language, with which every text is rejected.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    some = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    some = some.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    ids = some.select("i").orderBy(F.xxhash64("i"), "i").limit(max_labelled).collect()
    if not ids:
        return Model([], np.zeros((BUCKETS, 0)))
    sample = spark.createDataFrame(ids, some.select("i").schema).distinct()
    rows = (
        some.join(F.broadcast(sample), "i").select("lang", "text")
        .mapInArrow(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .collect()
    )  # BUCKETS small rows at most for each language of the sample
    languages = sorted({r["lang"] for r in rows})
    counts = np.zeros((BUCKETS, len(languages)))
    for r in rows:
        counts[r["gram"], languages.index(r["lang"])] = r["n"]
    return Model(languages, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)))


def text_scores(h: np.ndarray, model: Model) -> np.ndarray:
    n = int(h.sum())
    if not n or not model.languages:
        return np.zeros(len(model.languages))
    return (h @ model.logp) / n * min(n, TEXT_MOST) * TEXT_WEIGHT


def foreign_share(h: np.ndarray, model: Model, declared: str | None) -> float:
    """How far a text is from its declared language: about 1 where all of it is in another, 0 and less where none or half is.

    The mean gap of its trigrams' log-likelihoods, of the language that fits best over the declared one, as a
    share of the gap that a text of the former has on average. 0 without a trigram or a known declared language.
    """
    n, known = int(h.sum()), [x.lower() for x in model.languages]
    if not n or declared not in known:
        return 0.0
    fit = h @ model.logp / n
    d, best = known.index(declared), int(np.argmax(fit))
    return float((fit[best] - fit[d]) / model.gaps[best, d]) if model.gaps[best, d] > 0 else 0.0


def identify(
    rows: DataFrame, model: Model, id_col: str, text_col: str, declared: Column | None, host: Column, domain: Column, suffix: Column,
    markup: bool = False, least: float = 0.5,
) -> DataFrame:
    """(id_col, language, confidence, declared, host, n_trigrams, accepted, foreign), one row for each row; see ``foreign_share``.

    With ``markup`` the texts are HTML: their visible text is told, and where ``declared`` is None the lang
    attribute of their html element is the declared language. A text without letters in a host without evidence has the prior's language; it is
    rejected (accepted false) if it has no trigram at all or its confidence is below
    ``least``. Null texts count as empty; a null declared language, host, domain or suffix
    adds no evidence of its own; languages that tie go to the first by name. Repeated rows
    and null ids have a row each; an empty table gives an empty one; no other column is read.
    """
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    langs, from_page = model.languages, markup and declared is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, sizes, foreign, says = [], [], [], b.column(2).to_pylist()
            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                if markup and text:
                    tree = parse(text.replace("\x00", ""))
                    says[i] = page_language(tree) if from_page else says[i]
                    text = render_tree(tree)
                h = histogram(text)
                scores.append(text_scores(h, model).tolist())
                sizes.append(int(h.sum()))
                foreign.append(foreign_share(h, model, says[i]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(says, pa.string()), b.column(3), b.column(4), b.column(5), pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(foreign, pa.float64())],
                names=["id", "declared", "host", "domain", "suffix", "s", "n", "foreign"],
            )

    none = F.lit("")
    scored = rows.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (F.lit(None).cast("string") if declared is None else F.lower(declared.cast("string"))).alias("declared"),
        F.coalesce(host.cast("string"), none).alias("host"), F.coalesce(domain.cast("string"), none).alias("domain"), F.coalesce(suffix.cast("string"), none).alias("suffix"),
    ).mapInArrow(run, f"id {kind}, declared string, host string, domain string, suffix string, s array<double>, n long, foreign double")
    if not langs:
        return scored.select(
            F.col("id").alias(id_col), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), "declared", "host",
            F.col("n").alias("n_trigrams"), F.lit(False).alias("accepted"), "foreign")
    scored = written(scored, "text-evidence")
    k = range(len(langs))
    # What the text alone says, as shares; texts without a trigram say nothing.
    top = F.array_max("s")
    mass = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    shares = scored.select("n", "declared", "host", "domain", "suffix", *[F.when(F.col("n") > 0, F.exp(F.col("s")[i] - top) / mass).otherwise(0.0).alias(f"p{i}") for i in k])
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in k]
    total = shares.agg(*sums).first()
    prior = [(float(total[i] or 0) + 1) / (sum(float(x or 0) for x in total) + len(langs)) for i in k]
    # One row for each host: its own shares over its domain's over all, and its suffix's odds.
    by_host = written(shares.groupBy("host", "domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("copies")), "hosts")
    by_domain = by_host.groupBy("domain").agg(*[F.sum(f"p{i}").alias(f"d{i}") for i in k])
    by_suffix = by_host.groupBy("suffix").agg(*[F.sum(f"p{i}").alias(f"x{i}") for i in k])
    dn, hn, xn = (sum((F.col(f"{c}{i}") for i in k), F.lit(0.0)) for c in "dpx")
    every = sum(float(x or 0) for x in total)
    parts = []
    for i in k:
        of_domain = (F.col(f"d{i}") + KAPPA * prior[i]) / (dn + KAPPA)
        of_host = (F.col(f"p{i}") + KAPPA * of_domain) / (hn + KAPPA)
        in_general = (xn + 1) / (every + 1)
        of_suffix = (F.col(f"x{i}") + KAPPA * in_general) / (float(total[i] or 0) + KAPPA)
        parts.append(F.log(of_host) + F.when(F.col("suffix") == "", F.lit(0.0)).otherwise(F.log(of_suffix)))
    default = F.array(*[F.lit(math.log(p)) for p in prior])
    hosts = written(by_host.join(by_domain, "domain").join(by_suffix, "suffix").select(
        "host", "domain", "suffix", "copies", F.when(hn > 0, F.array(*parts)).otherwise(default).alias("e")), "host-evidence")
    # P(declared | l): how often texts of l are declared so; known languages only.
    told = shares.where("n > 0").where(F.col("declared").isin([x.lower() for x in langs])).groupBy("declared").agg(*sums).collect()  # a row for each language
    table_ = {r["declared"]: [float(r[f"p{i}"]) for i in k] for r in told}
    sure = [sum(v[i] for v in table_.values()) for i in k]
    odds = {d: [math.log((v[i] + KAPPA * (0.8 if langs[i].lower() == d else 0.2 / len(langs))) / (sure[i] + KAPPA)) for i in k] for d, v in table_.items()}
    says = F.array(*[F.lit(0.0) for _ in k])
    for d, v in odds.items():
        says = F.when(F.col("declared") == d, F.array(*[F.lit(x) for x in v])).otherwise(says)
    fused = with_labels(scored, hosts, ["host", "domain", "suffix"], "copies").withColumn("says", says)
    fused = fused.withColumn("f", F.array(*[F.col("s")[i] + F.col("says")[i] + F.col("e")[i] for i in k]))
    best = F.array_max("f")
    fused = fused.withColumn("best", best).withColumn("confidence", 1 / F.aggregate("f", F.lit(0.0), lambda a, x: a + F.exp(x - best)))
    names = F.array(*[F.lit(x) for x in langs])
    return fused.select(
        F.col("id").alias(id_col), names[F.array_position("f", F.col("best")).cast("int") - 1].alias("language"), F.round("confidence", 6).alias("confidence"),
        "declared", "host", F.col("n").alias("n_trigrams"), ((F.col("n") > 0) & (F.col("confidence") >= least)).alias("accepted"), "foreign")


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address; the domain is the last two labels of the host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    model = learn_languages(table(spark, sf_dir, "documents"))
    host, domain, suffix = address_parts(F.col("url"))
    return identify(table(spark, sf_dir, "pages"), model, "page_id", "html", None, host, domain, suffix, markup=True)

"""The stages against plain versions, on rows with nulls, copies, ties, long texts and clashing column names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import langid, toxicity
from tessera.llm.simhash import text_segments
from tests.llm.test_dedup import classes, near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {"i": 1, "toxic": "t", "id": 2, "__key": "k", "fp": 3.5, "component_id": 4, "kept": "no", "score": 0}


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("pipeline"))
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = given.collect()
    first = max(r.doc_id for r in rows) + 1
    a, b = rows[0], rows[1]
    more = [
        (first, a.text.upper(), a.lang, a.source, a.n_chars), (first + 1, a.text + " and so", a.lang, a.source, None), (first + 1, a.text + " and so", a.lang, a.source, None),
        (None, b.text, b.lang, None, 1), (None, "quite another text that stands alone here", "en", "s", 1), (first + 2, None, None, None, None), (first + 3, "", "en", "s", 0),
        (first + 4, " \t\n", None, "s", 3), (first + 5, b.text * 200, b.lang, b.source, 1), (first + 6, b.text, "xx", "never seen", 1),
    ]
    spark.createDataFrame([tuple(r) for r in rows] + more, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASHES.items()}).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").withColumn("text", F.lit("x")).write.parquet(f"{to}/labels.parquet")
    return to


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def keys(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_stages_are_named():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"] and pipeline.ORACLE_SQL is None


def test_language_stage(spark, docs, folder):
    rows, model = docs.collect(), langid.learn_languages(docs)
    k, kappa = len(model.languages), langid.KAPPA
    counts = [langid.histogram(r.text) for r in rows]
    scores = np.array([langid.text_scores(h, model) for h in counts])
    n = np.array([h.sum() for h in counts])
    share = np.exp(scores - scores.max(axis=1, keepdims=True))
    share = np.where(n[:, None] > 0, share / share.sum(axis=1, keepdims=True), 0)
    prior = (share.sum(axis=0) + 1) / (share.sum() + k)
    host = [r.source or "" for r in rows]
    keep = []
    for r, s, m, at, h in zip(rows, scores, n, host, counts, strict=True):
        own = share[[x == at for x in host]].sum(axis=0)
        of_host = (own + kappa * (own + kappa * prior) / (own.sum() + kappa)) / (own.sum() + kappa) if own.sum() > 0 else prior
        says = np.zeros(k)
        if r.lang and any(x.lang == r.lang and c > 0 for x, c in zip(rows, n, strict=True)) and r.lang in model.languages:
            told = {d: share[[x.lang == d and c > 0 for x, c in zip(rows, n, strict=True)]].sum(axis=0) for d in model.languages}
            sure = sum(told.values())
            says = np.array([math.log((told[r.lang][i] + kappa * (0.8 if x == r.lang else 0.2 / k)) / (sure[i] + kappa)) for i, x in enumerate(model.languages)])
        f = s + says + np.log(of_host)
        if m > 0 and 1 / np.exp(f - f.max()).sum() >= 0.5 and langid.foreign_share(h, model, r.lang) < pipeline.FOREIGN:
            keep.append(r)
    got = pipeline.language_id(spark, docs, folder)
    assert got.columns == docs.columns and keys(got.collect()) == keys(keep)
    assert pipeline.language_id(spark, docs.limit(0), folder).count() == 0


def test_toxicity_stage(spark, docs, folder):
    rows = docs.collect()
    scorer = toxicity.Scorer(toxicity.learn_lexicon(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    got = pipeline.toxicity(spark, docs, folder)
    assert got.columns == docs.columns and keys(got.collect()) == keys(r for r in rows if scorer.score(r.text) < toxicity.THRESHOLD)
    assert pipeline.toxicity(spark, docs.limit(0), folder).count() == 0


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_stage(spark, docs, folder):
    best = {}
    for r in docs.collect():
        k = lowered(r.text)
        if k not in best or (-1 if r.doc_id is None else r.doc_id) > (-1 if best[k].doc_id is None else best[k].doc_id):
            best[k] = r
    got = pipeline.exact(spark, docs, folder)
    assert got.columns == docs.columns and keys(got.collect()) == keys(best.values())
    assert pipeline.exact(spark, docs.limit(0), folder).count() == 0


def test_near_stage(spark, docs, folder):
    rows = docs.collect()
    seg = np.array([text_segments((r.text or "").encode(), 5) for r in rows])
    eq = (seg[:, None] == seg[None]) & (seg[:, None] != 0)
    met = (seg[:, None] == seg[None]).all(axis=2)
    for d in (1, 2, 3):
        met |= (eq & np.roll(eq, -d, axis=2)).any(axis=2)
    group = classes(range(len(rows)), [(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(met)), strict=True) if b < a])
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[group[i]] = min(r.doc_id, least.get(group[i], r.doc_id))
    got = pipeline.near(spark, docs, folder)
    assert got.columns == docs.columns and keys(got.collect()) == keys(r for i, r in enumerate(rows) if r.doc_id == least.get(group[i]))
    assert pipeline.near(spark, docs.limit(0), folder).count() == 0


def test_near_stage_catches_near_copies(spark, docs, folder):
    texts, pairs = near_copies(seed=9)
    first = docs.agg(F.max("doc_id")).first()[0] + 1
    more = docs.limit(0).unionByName(spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in pipeline.near(spark, docs.union(more), folder).collect()}
    copies = {b for _, b in pairs}
    assert sum(first + b not in kept for b in copies) >= 0.9 * len(copies)
    assert all(first + i in kept for i in range(0, len(texts), 4))  # the first text of each group


def test_foreign_share_of_whole_and_mixed_texts():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(langid.BUCKETS, 0.05), 2).T + 1e-7
    model = langid.Model(["aa", "bb"], np.log(p / p.sum(axis=0)))
    a, b = (rng.multinomial(4000, np.exp(model.logp[:, i]) / np.exp(model.logp[:, i]).sum()) for i in (0, 1))
    assert 0.9 < langid.foreign_share(a, model, "bb") < 1.1 and langid.foreign_share(a, model, "aa") == 0
    assert langid.foreign_share(a + b, model, "bb") < 0.3 and langid.foreign_share(a * 9 + b, model, "bb") > 0.7
    assert langid.foreign_share(a, model, "xx") == langid.foreign_share(a, model, None) == langid.foreign_share(a * 0, model, "bb") == 0


def test_language_stage_drops_a_text_that_is_not_in_its_language(spark, docs, folder):
    rows = [r for r in docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 500").collect()]
    first = {lang: next(r for r in rows if r.lang == lang) for lang in sorted({r.lang for r in rows} - {"xx"})}
    (a, one), (b, two), *_ = first.items()
    planted = docs.where(F.col("doc_id").isin(one.doc_id, two.doc_id)).withColumn("lang", F.when(F.col("lang") == a, b).otherwise(a)).withColumn("doc_id", F.col("doc_id") + 10**9)
    assert planted.count() >= 2
    kept = {r.doc_id for r in pipeline.language_id(spark, docs.union(planted), folder).collect()}
    assert not kept & {r.doc_id for r in planted.collect()} and {one.doc_id, two.doc_id} <= kept


def test_the_whole_is_its_stages(spark, folder):
    out = pipeline.run(spark, folder).collect()
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, folder).collect(), kept.schema)
    texts = {r.doc_id: r for r in kept.collect()}
    words = {}
    bins = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert words == {i: len((r.text or "").encode().split()) for i, r in texts.items()}
    for mine in bins.values():
        assert sum(r.n_words for r in mine) <= 2048
        sources = [texts[r.doc_id].source for r in mine if texts[r.doc_id].source is not None]
        assert len(sources) == len(set(sources))

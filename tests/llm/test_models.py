import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, toxicity
from tessera.llm.toxicity import Lexicon, Scorer, Trie, edits, quoted


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_what_distance_finds():
    terms = {"worthless": 0.9, "idiot": 0.8, "scum": 0.9, "pathetic": 0.7, "disgusting": 0.6}
    trie, rnd = Trie(terms), random.Random(2)
    found = 0
    for _ in range(4000):
        w = list(rnd.choice(list(terms)))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w))
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "o", "t"])
            w = w or ["x"]
        w = "".join(w)
        want = {(t, d) for t in terms if 0 < (d := distance(w, t)) <= edits(t)}
        got = trie.near(w)
        assert got is None or got in want
        if any(d == 1 for _, d in want) and not got:
            raise AssertionError(w)
        found += bool(got)
    assert found > 300
    assert trie.near("scums") is None and trie.near("idoit") is None and trie.near("") is None


def test_automaton_finds_every_distance_that_a_term_allows():
    terms = {"worthless": 0.9, "idiot": 0.8, "disgusting": 0.6, "contemptible": 0.7, "scum": 0.9}
    trie, rnd = Trie(terms), random.Random(5)
    assert trie.near("wprthlesd") == ("worthless", 2)
    far = 0
    for _ in range(6000):
        w = list(rnd.choice(list(terms)))
        for _ in range(rnd.randint(1, 3)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "o", "t"])
            w = w or ["x"]
        w = "".join(w)
        want = {(t, d) for t in terms if 0 < (d := distance(w, t)) <= edits(t)}
        assert trie.near(w) == max(want, key=lambda x: terms[x[0]], default=None), w
        far += any(d == 2 for _, d in want)
    assert far > 500


def test_quotation_counts_less():
    s = Scorer(Lexicon({"idiot": 0.9, "pathetic": 0.9}, {"idiot": 0.45, "pathetic": 0.45}))
    assert s.score("you idiot") >= 0.7 > s.score('she said "you idiot" to them') > 0
    assert abs(s.score("you idiott") - 0.45) < 1e-9 and s.score("clean words") == s.score("") == s.score(None) == 0.0
    assert quoted('a "x" b', 3, 4) and not quoted("a x b", 2, 3)
    assert s.score("idiot " * 10_000) <= 1.0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op7_toxicity(spark, sf)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == docs.count()
    for r in rows.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = {(r.toxic, r.predicted): r["count"] for r in rows.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()}
    assert out[1, 1] / (out[1, 1] + out.get((1, 0), 0)) > 0.6
    assert out.get((0, 1), 0) / (out[0, 0] + out.get((0, 1), 0)) < 0.02


def test_toxicity_edges(spark, sf):
    docs = spark.createDataFrame([(1, None, 0), (None, "an idiot", 1), (2, "an idiot", 0), (2, "an idiot", 0)], "doc_id long, text string, score int")
    none = toxicity.learn_lexicon(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.terms == {} and toxicity.score_toxicity(docs, none).where("score = 0").count() == 4
    same = toxicity.learn_lexicon(docs, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int"))
    assert same.terms == {}
    got = toxicity.score_toxicity(docs, Lexicon({"idiot": 0.9}, {}))
    assert sorted((str(r.doc_id), r.predicted) for r in got.collect()) == [("1", 0), ("2", 1), ("2", 1), ("None", 1)]
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_languages_of_texts_that_were_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn_languages(docs.where("doc_id % 2 = 0"))
    assert model.languages == ["de", "en", "es", "fr"]
    src = F.col("source")
    alone = langid.identify(docs.where("doc_id % 2 = 1"), model, "doc_id", "text", F.lit(None), src, src, F.lit("")).join(docs.select("doc_id", "lang"), "doc_id")
    assert alone.where("language = lang").count() / alone.count() > 0.95
    assert alone.where("NOT accepted").count() == 0


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(1, "the word and the other", "en", "h"), (2, "und das andere wort", "de", None), (None, None, None, None), (4, "12 ?!", "xx", "h"), (1, "the word and the other", "en", "h"),
         (5, "the and " * 100_000, "en", "h")], "doc_id long, text string, lang string, source string")
    model = langid.learn_languages(docs)
    src = F.col("source")
    got = langid.identify(docs, model, "doc_id", "text", F.col("lang"), src, src, F.lit("")).collect()
    assert len(got) == 6
    assert sorted((str(r.doc_id), r.language, r.accepted) for r in got if r.n_trigrams) == [
        ("1", "en", True), ("1", "en", True), ("2", "de", True), ("5", "en", True)]
    assert [r.accepted for r in got if not r.n_trigrams] == [False, False]
    nothing = langid.learn_languages(docs.limit(0))
    assert langid.identify(docs, nothing, "doc_id", "text", F.col("lang"), src, src, F.lit("")).where("accepted").count() == 0
    assert langid.identify(docs.limit(0), model, "doc_id", "text", F.col("lang"), src, src, F.lit("")).count() == 0


def test_trigrams_run_over_blocks():
    text = "abc def " * 300_000
    assert abs(int(langid.histogram(text).sum()) - len(text)) < 20
    assert not langid.histogram("... 123").any() or int(langid.histogram("... 123").sum()) <= 1
    assert np.array_equal(langid.histogram(None), langid.histogram(""))


PAGES = [
    (1, "https://a.example.de/x", '<!-- <html lang="fr"> --><html data-lang="es" xml:lang="es" lang="de-AT"><body>und das andere wort ist hier und dort'),
    (2, "http://user@b.example.de:80/?q", "<html " + 'class="' + "x " * 900 + '" lang=de><p>und das wort ist das andere wort und hier'),
    (3, None, "<p>the word and the other word is here and there"), (4, "not an address", ""), (5, "https://c.example.com", None), (None, "https://c.example.com", "<html lang='xx'>the other word and the word"),
    (6, "https://c.example.com", "<html lang=''><script>und das</script>12 34"), (6, "https://c.example.com", "<html lang=''><script>und das</script>12 34"),
    (7, "ftp://c.example.com#f", "<html lang=en>" + "the word and " * 60_000), (8, "https://c.example.com", "<html lang=en>und das andere wort"),
]


def test_op4_against_a_plain_version(spark, tmp_path):
    import math
    from html.parser import HTMLParser
    from urllib.parse import urlsplit

    from tessera.llm.html_text import render

    docs = [(i, ("the word and the other word is here and there " if i % 2 else "und das andere wort ist hier und dort ") * 3, "en" if i % 2 else "de", "s") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, language string, host int").write.parquet(f"{tmp_path}/pages.parquet")

    class First(HTMLParser):
        lang = None

        def handle_starttag(self, tag, attrs):
            if tag == "html":
                self.lang = (dict(attrs).get("lang") or "").split("-")[0].lower() or None

    def declared(page):
        p = First()
        p.feed(page or "")
        return p.lang

    model = langid.learn_languages(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    k, kappa, langs = len(model.languages), langid.KAPPA, model.languages
    counts = [langid.histogram(render(h)) for _, _, h in PAGES]
    n = [int(c.sum()) for c in counts]
    scores = np.array([langid.text_scores(c, model) for c in counts])
    share = np.exp(scores - scores.max(axis=1, keepdims=True))
    share = np.where(np.array(n)[:, None] > 0, share / share.sum(axis=1, keepdims=True), 0)
    host = [(urlsplit(u or "").hostname or "") for _, u, _ in PAGES]
    domain, suffix = [".".join(h.split(".")[-2:]) for h in host], [h.split(".")[-1] for h in host]
    prior = (share.sum(axis=0) + 1) / (share.sum() + k)
    says = [declared(h) for _, _, h in PAGES]
    assert says == ["de", "de", None, None, None, "xx", None, None, "en", "en"]
    want = []
    for i, (page, _, _) in enumerate(PAGES):
        own, dom, suf = (share[[x == kind[i] for x in kind]].sum(axis=0) for kind in (host, domain, suffix))
        e = np.log((own + kappa * (dom + kappa * prior) / (dom.sum() + kappa)) / (own.sum() + kappa)) if own.sum() > 0 else np.log(prior)
        if own.sum() > 0 and suffix[i]:
            e = e + np.log((suf + kappa * (suf.sum() + 1) / (share.sum() + 1)) / (share.sum(axis=0) + kappa))
        f = scores[i] + e
        told = {d: share[[says[j] == d and n[j] > 0 for j in range(len(PAGES))]].sum(axis=0) for d in langs if d in [says[j] for j in range(len(PAGES)) if n[j] > 0]}
        if says[i] in told:
            sure = sum(told.values())
            f = f + np.array([math.log((told[says[i]][j] + kappa * (0.8 if x == says[i] else 0.2 / k)) / (sure[j] + kappa)) for j, x in enumerate(langs)])
        sure_of = 1 / np.exp(f - f.max()).sum()
        want.append((page, langs[int(np.argmax(f))], round(sure_of, 4), says[i], host[i], n[i], n[i] > 0 and sure_of >= 0.5))
    got = [(r.page_id, r.language, round(r.confidence, 4), r.declared, r.host, r.n_trigrams, r.accepted) for r in langid.op4_language_id(spark, str(tmp_path)).collect()]
    order = lambda x: tuple(map(str, x))
    assert sorted(got, key=order) == sorted(want, key=order)


def test_equal_evidence_goes_to_the_first_by_name(spark):
    docs = spark.createDataFrame([(1, "same words here", "fr", "h"), (2, "same words here", "en", "h")], "doc_id long, text string, lang string, source string")
    got = langid.identify(docs, langid.learn_languages(docs), "doc_id", "text", F.lit(None), F.lit(None), F.lit(None), F.lit(None)).collect()
    assert [r.language for r in got] == ["en", "en"]


def test_no_number_of_languages_is_too_many(spark):
    docs = spark.createDataFrame([(i, " ".join(chr(97 + (i * 7 + j * 3) % 26) * 3 for j in range(12)) + f" {chr(0x4E00 + i)}" * 30, f"l{i:03}", "h") for i in range(90)], "doc_id long, text string, lang string, source string")
    model = langid.learn_languages(docs)
    assert len(model.languages) == 90
    got = langid.identify(docs.where("doc_id IN (3, 70, 89)"), model, "doc_id", "text", F.lit(None), F.lit(None), F.lit(None), F.lit(None)).collect()
    assert {(r.doc_id, r.language) for r in got} == {(3, "l003"), (70, "l070"), (89, "l089")}


def test_scores_are_those_of_a_plain_scorer(spark, sf):
    """Every distance by dynamic programming, every hit by its own scan."""
    import re

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.learn_lexicon(docs, labels)
    some = dict(sorted(lexicon.terms.items(), key=lambda x: -len(x[0]))[:6]) or {"worthless": 0.9}
    lexicon = Lexicon(some | {"idiot": 0.8, "worthless": 0.9}, {t: 0.4 for t in [*some, "idiot", "worthless"]})
    rows = docs.select("doc_id", "text").limit(40).collect() + docs.select("doc_id", "text").join(labels.where("toxic = 1"), "doc_id").select("doc_id", "text").limit(10).collect()
    extra = spark.createDataFrame([(-1, "You wprthlesd idot!"), (-2, 'she said "worthless"'), (-3, None)], "doc_id long, text string")
    rows += extra.collect()
    memo = {}

    def weight(w):
        if w not in memo:
            near = [(lexicon.terms[t], t) for t in lexicon.terms if abs(len(t) - len(w)) <= edits(t) and distance(w, t) <= edits(t)]
            memo[w] = lexicon.terms.get(w) or (lexicon.spelled[max(near)[1]] if near else 0.0)
        return memo[w]

    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()}
    for r in rows:
        text, rest = (r.text or "").lower(), 1.0
        for m in re.finditer(r"[^\W\d_]+", text):
            rest *= 1 - weight(m[0]) * (0.5 if quoted(text, m.start(), m.end()) else 1)
        assert abs(got[r.doc_id] - (1 - rest)) < 1e-8
    assert got[-1] > 0.5 > got[-2] > 0

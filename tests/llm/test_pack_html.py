import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.html_text import extract_text, parse, render
from tessera.llm.packing import Bins, best_fit_pack, pack_shard, word_count


def test_successor_search_is_best_fit():
    rnd = random.Random(3)
    bins, plain = Bins(64), []  # plain: [room, mask]
    for _ in range(600):
        need, bits = rnd.randint(1, 64), 2 << rnd.randrange(5) | (64 << rnd.randrange(40) if rnd.random() < 0.3 else 0)
        fits = [(r, i) for i, (r, m) in enumerate(plain) if r >= need and not m & bits]
        best = bins.best(need, bits)
        assert (best is None) == (not fits)
        if fits:
            assert plain[best][0] == min(fits)[0]
        b, offset = bins.put(need, bits)
        if b == len(plain):
            plain.append([64, 0])
        assert offset == 64 - plain[b][0]
        plain[b][0] -= need
        plain[b][1] |= bits
        assert bins.room[b] == plain[b][0] >= 0


def test_pack_shard_edges():
    assert pack_shard([(0, "a", None)], 10) == [(0, 0, None, 0, 0, 0)]
    rows = pack_shard([(25, None, None), (5, None, None)], 10)
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [(0, 0, 0, 10), (0, 1, 10, 10), (0, 2, 20, 5), (1, 0, 0, 5)]
    assert rows[2][2] == rows[3][2]


@pytest.mark.parametrize("hot", [False, True])
def test_packing_holds_its_rules(spark, hot):
    docs = spark.range(700).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, None).otherwise(F.expr("repeat('w ', cast(id * 37 % 90 as int))")).alias("text"),
        F.when((F.col("id") % 3 == 0) & F.lit(hot), "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"), F.lit(1).alias("bin_id"))
    rows = best_fit_pack(docs, word_count(F.col("text")), capacity=64, cluster=F.col("doc_id") % 100, shard_items=200).collect()
    want = {d.doc_id: (d.n, d.source) for d in docs.select("doc_id", "source", word_count(F.col("text")).alias("n")).collect()}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.bin_id is not None:
            by_bin.setdefault(r.bin_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        assert sum(r.n_words for r in own) == want[i][0]
        assert [r.start for r in sorted(own, key=lambda r: r.piece)] == [64 * k for k in range(len(own))]
    for own in by_bin.values():
        assert sum(r.n_words for r in own) <= 64
        spans = sorted((r.bin_offset, r.bin_offset + r.n_words) for r in own)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for key in (lambda r: want[r.doc_id][1], lambda r: r.doc_id % 100):
            assert len({key(r) for r in own}) == len(own)
    assert best_fit_pack(docs.limit(0), F.lit(1)).count() == 0


CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("a<br>b", "a\nb"), ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=2><li>a<li>b</ol>", "2. a\n3. b"), ("<ul><li>a<ul><li>b</ul></ul>", "- a\n  - b"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
    ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", "x | y\n  | z"),
    ("<head><title>t</title></head><body>x", "x"), ("<script>if (a<b) '</p>'</script>x<style>p{}</style>", "x"),
    ("<div hidden>a</div><div style='Display : None'>b</div>c", "c"), ("a <b> b</b>c", "a bc"), ("x &lt; y &amp;amp; z", "x < y &amp; z"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("<!-- a --><!doctype html>b", "b"), ("<a href='>'>x</a>", "x"), ("<p>a</div></b>b", "ab"),
    ("1 < 2 <3", "1 < 2 <3"), ("<details>z<summary>s</summary>h</details>", "s"), ("<blockquote>q</blockquote>", "q"), ("<select><option>a<option>b</select>", "a\nb"),
    ("<div>a</div><div>b</div>", "a\nb"), ("<p hidden>x", ""), ("</p>x", "x"), ("<TD>a</TD>", "a"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_render(page, text):
    assert "\n".join(x.strip() if "blockquote" in (page or "") else x for x in render(page).split("\n")) == text


SEEN = [
    ("<table><form><tr><td>a<td>b</form></table>", "a | b"), ("<table><colgroup><col><tr><td>a<td>b</table>", "a | b"), ("<table><colgroup><col><col></colgroup><tbody><tr><td>a</table>", "a"),
    ("<table><tr><form><td>a<td>b</table>", "a | b"), ("<table><tr><a><td>a<td>b</table>c", "a | b\n\nc"), ("<table><tbody>x<tr>y<td>a</table>", "xy\n\na"),
    ("<table><div>x</div><tr><td>a</table>", "x\n\na"), ("<table><tr><div>x<td>a</td></div><td>b</table>", "x\n\na | b"), ("<p>o<table>x <b>y</b> z<tr><td>a</table>", "o\n\nx y z\n\na"),
    ("<table>a < b<tr><td>c</table>", "a < b\n\nc"), ("<table><caption>c<tr><td>a</table>", "c\na"), ("<table><tr><table><tr><td>a</table>b", "a\n\nb"),
    ("<table><tr><td>a<table><tr><td>b</tr></table>c</table>", "a\n\nb\n\nc"), ("<table><template><tr><td>x</template><tr><td>a</table>", "a"),
    ("<table><script>x</script><style>y</style><tr><td>a</table>", "a"), ("<table><ul><li>x</ul><tr><td>a</table>", "- x\n\na"), ("<table><select><option>x</select><tr><td>a</table>", "x\n\na"),
    ("<details><summary>a<br>b</summary>h</details>", "a\nb"), ("<details><summary>a</summary><summary>b</summary></details>", "a"),
    ("a <math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "a x=1"), ("<map><area>m</map>", "m"), ("a <textarea>\nb\n c</textarea>", "a b\n c"),
    ("<svg><title>t</title><defs/><g><path d=''/><text>a</text></g></svg>b", "a\nb"), ("<svg><defs><text>x</text></defs><rect>r</rect><foreignObject><p>a</p></foreignObject></svg>", "a"), ("<svg><g><p>a</p>", "a"),
    ("<div style='visibility:hidden'>x<b style='visibility: visible'>a</b><p>y</div>c", "a\nc"), ("<p style='visibility:hidden'>x</p>a", "a"),
    ("<svg><title/><text>a</text></svg>b", "a\nb"), ("<table><tr><td><template><tr><td>x</template>a<td>b</table>", "a | b"),
    ("<div style='display:none'><b style='visibility:visible'>x</b></div>a", "a"),
]


@pytest.mark.parametrize("page,text", SEEN)
def test_all_that_a_browser_shows_is_kept(page, text):
    assert render(page) == text


def test_broken_markup_never_fails():
    rnd = random.Random(1)
    bits = ["<", ">", "</", "<p", "<table>", "<td>", "</tr>", "<li>", "'", '"', "x", " ", "&", "&#", "<!--", "-->", "<script>", "=", "<pre>", "</table>", "<a href="]
    for _ in range(3000):
        render("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))))
    assert render("<div>" * 50_000 + "x") == "x"
    assert parse("<td>a").tag == "html"


def test_every_word_of_the_body_is_kept(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit(1))
    rows = extract_text(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    assert extract_text(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "<p>a"), (1, "<p>a")], "page_id long, html string")
    assert sorted((str(r.page_id), r.text) for r in extract_text(odd).collect()) == [("1", ""), ("1", "a"), ("1", "a"), ("None", "")]

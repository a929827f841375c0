"""URL rules and trees, wrappers, and the vector index."""

from __future__ import annotations

import random
import time
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import ann, url_filter, wrappers

URLS = [
    (1, "http://A.Example.COM/en/7x?q=1"), (2, "https://b.com/en/1"), (3, "http://x.example.net/de/8"), (4, "http://y.net/de/7"), (5, "ftp://org/es/"), (6, "http://notorg/es/1"), (7, None), (8, "no scheme"), (9, "http://u.org#/es/"), (10, "http://u.org/es?x://y.net/de/"),
    (11, "http://example.com/en/70"), (12, "a://b://net/de/1"), (12, "a://b://net/de/1"), (None, ""),
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = lambda t, stops: t[: min([t.find(c) for c in stops if c in t], default=len(t))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = host.lower()
    fits = [r for r, _ in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_rules_are_brute_force(spark):
    df = spark.createDataFrame([(i, u, 1) for i, u in URLS], "page_id long, url string, host int").drop("host")
    got = url_filter.judged(df, url_filter.UrlModel(url_filter.rule_labels(df))).collect()
    assert len(got) == len(URLS)
    want = dict(url_filter.RULES)
    for r in got:
        host, path, rule = brute_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert r["verdict"] == want[rule] if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judged(df.filter("false"), url_filter.UrlModel(url_filter.rule_labels(df.filter("false")))).count() == 0


def test_trees_learn_urls(spark):
    rng = random.Random(2)
    good = [f"https://{rng.choice(['www', 'm', 'blog'])}.site{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}.org/en/{rng.randint(1, 999)}" for _ in range(400)]
    bad = [f"http://{rng.choice(['casino', 'cheap'])}-{chr(97 + rng.randrange(26))}{rng.randint(0, 99)}.net/x/{rng.randint(1, 10**9)}?a=1&b=2" for _ in range(100)]
    rows = [(u, 0) for u in good] + [(u, 1) for u in bad]
    rng.shuffle(rows)
    model = url_filter.UrlModel(spark.createDataFrame(rows[:350], "url string, label int"))
    p = model.predict([u for u, _ in rows[350:]])
    assert np.mean((p >= 0.5) == np.array([y for _, y in rows[350:]])) > 0.97


def test_held_out_hosts(spark):
    """Rule labels carry over to hosts that the model has not seen, by several features; scores don't depend on the layout."""
    rng = random.Random(6)
    urls = [(f"http://{rng.choice(['www', 'm', 'blog'])}.h{h:02d}.{t}/{lang}/{rng.randint(1, 9999)}{rng.choice(['', '/', '.html', '?a=1'])}",) for h, t in ((h, rng.choice(("com", "net", "org"))) for h in range(80)) for lang in (rng.choice(("en", "de", "es")) for _ in range(25))]
    labels = url_filter.rule_labels(spark.createDataFrame(urls, "url string"))
    held = F.col("url").rlike(r"h[67]\d\.")
    models = [url_filter.UrlModel(labels.filter(~held).repartition(n)) for n in (1, 5)]
    rows = labels.filter(held).collect()
    p = [m.predict([r["url"] for r in rows]) for m in models]
    y = np.array([r["label"] for r in rows])
    assert len(y) > 50 and np.array_equal(*p)
    assert np.mean((p[0] >= 0.5) == y) > max(y.mean(), 1 - y.mean()) + 0.05
    used = {int(f) for feat, cut, _ in models[0].trees.trees for f, c in zip(feat, cut, strict=True) if c < models[0].trees.n_bins}
    assert len(used) > 2


def test_statistics_leave_out_the_own_host():
    stats = url_filter.Statistics(np.array([3.0, 1.0]), np.array([2.0, 1.0]), 0.5)
    assert stats.shares(np.array([[0, 1]])).tolist() == [[(2 + 1) / 5, (1 + 1) / 3]]
    assert stats.shares(np.array([[0, 1]]), np.array([[1.0, 1.0]])).tolist() == [[(1 + 1) / 4, 0.5]]


def test_boosting_fits_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = url_filter.BoostedTrees().fit(x[:1500], y[:1500])
    assert np.mean((trees.predict(x[1500:]) > 0.5) == y[1500:]) > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>no</article>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=/a>A</a></li><li>B</li></ul></nav>{ad}
<article class="post"><h1>Head {n}</h1><p><b>One &amp; two<br>three</b> <i>x</i></p><p>Fo&#117;r  <!-- no -->
five</p><ul><li>{n} item</li><li>more</li></ul><aside>See also</aside><form><p>Sign up</p></form></article>
<section id="comments"><p>Nice {n}</p></section><footer>&copy; Site</footer>"""
TEXT = "Head {n}\n\nOne & two three x\n\nFour five\n\n{n} item\n\nmore"


def test_wrappers_extract_the_article(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(n=i, ad='<div class="ad">Buy</div>' if i % 3 else "")) for i in range(30)]
    rows += [(50, None, None), (51, "http://h0.org/x", ""), (52, "x", "plain <b>text</b> &lt;only&gt;"), (53, "http://h1.org/y", "<article><p>open <p>tags"), (54, "http://z/", "<p>" + "long " * 50_000), (None, "http://z/", "<"), (54, "http://z/", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    for how in ({}, {"broadcast_bytes": 0}):
        got = wrappers.extract(df, **how).collect()
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
        by = {r["page_id"]: r["text"] for r in got}
        assert all(by[i] == TEXT.format(n=i) for i in range(30))
        assert (by[50], by[51], by[52], by[53]) == ("", "", "plain text <only>", "open\n\ntags")
        assert len(by[54]) == 249_999 and by[None] == "<"
    assert wrappers.extract(df.filter("false")).count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        ('<body><div class="social-policy"><p>All of it</p></div></body>', "All of it"), ('<div id="comment-on-budget"><p>T</p></div>', "T"), ('<body><nav>x</nav><FORM id="aspnetForm"><div><p>Body text</p></div></FORM></body>', "Body text"),
        ("<body><p><a href=x>linked text of the page</a> end</p></body>", "linked text of the page end"), ('<body><article><p>A</p><div class="widget-table"><p>Figures for 2020</p></div></article>', "A\n\nFigures for 2020"),
        ("<article><p>Energy is <math>E</math> here</p><p><object>a</object> <svg><text>b</text></svg></p></article>", "Energy is E here\n\na b"), ("<nav>a</nav><footer>b</footer><form><input></form>", ""), ("text <b", "text <b"),
        ('x <a href="y>z">t</a> u', "x t u"), ("<p>a < b and c > d</p>", "a < b and c > d"), ("a<!-- b", "a"), ("a<script>b", "a"), ("a<script>b</script>c", "ac"), ("a<!-- b --> c", "a c"), ("<p>a<!-- b --> > c <", "a > c <"),
    ],
)
def test_text_of_a_page(html, text):
    assert wrappers.Extractor(None).text(html) == text


@pytest.mark.parametrize("piece", ['<a "\'', "<a =", '<a =">" ', "<a ", "<!--", "<script>", "<a b='", "<", "<!", "<div ", "<a b=\"x' ", "<select>", "</a '"])
def test_time_grows_with_the_page(piece):
    for end in ("", ">", "='>\">"):
        began = time.perf_counter()
        wrappers.parse(piece * (1_000_000 // len(piece)) + end)
        assert time.perf_counter() - began < 4


def test_wrapper_decides_within_articles():
    """What a name may mean either way stays where its text differs over the host's pages, and goes where it doesn't."""
    page = '<body><article><p>Text {n}</p><div class="widget-table"><p>{a}</p></div></article></body>'
    for a, kept in (("Numbers of {n}", True), ("Follow us", False)):
        pages = [page.format(n=i, a=a.format(n=i)) for i in range(8)]
        extractor = wrappers.Extractor(wrappers.infer(pages))
        assert [extractor.text(x) for x in pages] == [f"Text {i}" + (f"\n\n{a.format(n=i)}" if kept else "") for i in range(8)]
    assert wrappers.Extractor(None).text(pages[0]) == "Text 0\n\nFollow us"


def test_wrapper_is_a_union_free_expression():
    w = wrappers.infer([PAGE.format(n=i, ad='<div class="ad">Buy</div>' if i % 2 else "") for i in range(6)])
    assert "(<div.ad>#</div>)?" in w["regex"] and w["article"]
    two = wrappers.infer(["<div>a</div><div>b</div><p>c", "<div>a</div><p>c"])
    assert two["regex"] == "(<div>#</div>)+<p>#</p>"
    more = wrappers.infer(["<article><h1>a</h1><p>b</p><p>c</p></article>", "<article><h1>a</h1><p>b</p><ul><li>c</li><li>d</li></ul></article>"])
    assert more["regex"] == "<article><h1>#</h1>(<p>#</p>)+(<ul>(<li>#</li>)+</ul>)?</article>"


def test_host_without_article(spark):
    page = "<html><body><div class=menu><a href=1>one</a></div><div id=x><p>Text {n} of some length</p></div><div class='cookie notice'>We use</div><div>All rights</div></body></html>"
    df = spark.createDataFrame([(i, "http://a.b/", page.format(n=i)) for i in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.extract(df).collect()} == {f"Text {i} of some length" for i in range(8)}


def test_host_that_mixes_templates(spark):
    kinds = ["<html><body><article><p>Story {n} of the day</p></article><div>Menu</div></body></html>", "<html><body><div><p>Plain {n} of the day</p></div></body></html>", "<html><body><table><tr><td>Cell {n} of the day</td></tr></table></body></html>", "<html><body><div class=content>Note {n} of the day</div></body></html>"]
    df = spark.createDataFrame([(i, "http://mix.org/", kinds[i % 4].format(n=i)) for i in range(60)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert got == {i: f"{('Story', 'Plain', 'Cell', 'Note')[i % 4]} {i} of the day" for i in range(60)}


def test_links_are_weighed_against_whole_texts():
    page = "<html><body><div><p>{text}</p><p><a href=/x>{link}</a></p></div></body></html>"
    pages = [page.format(text=f"{n:04d} " + "word " * 570, link="link " * 30) for n in range(12)]
    e = wrappers.Extractor(wrappers.infer(pages))
    assert all(len(e.text(p)) > 2500 for p in pages)
    alike = ["<html><body><div><p>" + "same " * 60 + f"{n}</p></div><p>All rights</p></body></html>" for n in range(12)]
    e = wrappers.Extractor(wrappers.infer(alike))
    assert [e.text(p) for p in alike] == ["same " * 60 + str(n) for n in range(12)]


def test_wrapper_knows_all_pages(spark):
    page = "<html><body><article><section class=summary><p>{s}</p></section><p>Story {n}</p></article></body></html>"
    rows = [(i, "http://big.org/", page.format(n=i, s=f"Correction {i}" if i == 150 else "No summary.")) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    dealt = [{r["page_id"]: r["text"] for r in wrappers.extract(df.repartition(n, "page_id")).collect()} for n in (1, 7)]
    assert dealt[0] == dealt[1] and dealt[0][150] == "Correction 150\n\nStory 150" and dealt[0][1] == "No summary.\n\nStory 1"
    fixed = {r["text"] for r in wrappers.extract(df.filter("page_id != 150")).collect()}
    assert fixed == {f"No summary.\n\nStory {i}" for i in range(300) if i != 150}  # nothing within an article goes


def test_nothing_of_an_article_is_lost(spark):
    named = ['<article class="post related">{t}</article>', '<main><section class="review-search-results">{t}</section></main>', '<div class="page has-sidebar form"><article>{t}</article></div>', "<form id=aspnet><main>{t}</main></form>", '<main><article class="post comments-open">{t}</article></main>']
    body = "<h1>Weather report</h1><p>Rain number {n}</p><p>As ever.</p>"
    rows = [(10 * k + n, f"http://host{k}.org/{n}", "<nav><a href=/>x</a></nav>" + x.format(t=body.format(n=n)) + "<footer>f</footer>") for k, x in enumerate(named) for n in range(10)]
    links = "<html><body><div><p>{text}</p>" + "<a href=/x>a short link of it</a> " * 4 + "</div></body></html>"
    rows += [(900 + n, "http://links.org/", links.format(text=f"{n} " + "word " * 700)) for n in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert all(got[10 * k + n] == f"Weather report\n\nRain number {n}\n\nAs ever." for k in range(len(named)) for n in range(10))
    assert all(len(got[900 + n]) > 3500 for n in range(12))


def test_reader_comments_go():
    page = "<main><article><p>Text</p></article><article class='comment'><p>Nice</p></article><div id='comment-list'><article><p>Too</p></article></div></main>"
    assert wrappers.Extractor(None).text(page) == "Text"


@pytest.mark.parametrize("html", ["<div>" * 5000 + "deep", "<article>" + "<section>" * 3000 + "<p>deep</p>", "<ul><li>" * 2000 + "deep", "<div>" * 2000 + "</p></section></div>" * 2000 + "deep"])
def test_deep_pages(spark, html):
    df = spark.createDataFrame([(1, "http://deep.org/", html), (2, "http://deep.org/", "<div>flat</div>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()} == {1: "deep", 2: "flat"}


def test_many_siblings():
    rng = random.Random(8)
    pages = ["".join(f"<{t}>x</{t}>" for t in (rng.choice(("div", "section", "table", "ul")) for _ in range(3000))) for _ in range(2)]
    began = time.perf_counter()
    e = wrappers.Extractor(wrappers.infer(pages))
    assert all(e.text(p).count("x") == 3000 for p in pages) and time.perf_counter() - began < 5


@pytest.mark.parametrize("most", [4096, 7])
def test_alignment_is_a_common_subsequence(most):
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 20))] for _ in range(2))
        pairs = wrappers.aligned(a, b, most)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:], strict=False))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1] or most == 7


def test_generated_pages_against_brute_force(spark):
    """Pages made from trees: the main text is what the trees' article blocks hold, in order."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 12)))
    rows, want = [], {}
    for i in range(120):
        blocks, html = [], []
        for _ in range(rng.randint(1, 7)):
            kind, text = rng.choice(("p", "h2", "li", "blockquote", "td")), sentence()
            blocks.append(text)
            shown = text.replace(" ", rng.choice((" ", "  ", "\n", "<br>", " <b>", "</b> ")), 1)
            inner = f"<{kind}>{shown}</{kind}>"
            html.append({"li": f"<ul>{inner}</ul>", "td": f"<table><tr>{inner}</tr></table>"}.get(kind, inner))
            if rng.random() < 0.3:
                html.append(f"<div class='{rng.choice(('ad', 'site-nav', 'share', 'cookie-notice'))}'>{sentence()}</div>")
        want[i] = "\n\n".join(blocks)
        rows.append((i, f"https://g{i % 3}.org/{i}", f"<html><head><title>{word()}</title></head><body><header>{sentence()}</header><{'article' if i % 2 else 'main'}>{''.join(html)}</{'article' if i % 2 else 'main'}><aside>{sentence()}</aside></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()} == want


def _product(a, b):
    return reduce(lambda s, xy: s + float(xy[0]) * float(xy[1]), zip(a, b, strict=True), 0.0)  # in order, as sum() would not


def _exact(rows, ids, k):
    out = {}
    for q in ids:
        s = sorted((-_product(rows[q], v), i) for i, v in rows.items() if i != q)[:k]
        out[q] = [(i, -x) for x, i in s]
    return out


@pytest.mark.parametrize("block", [4096, 20])
def test_index_recall(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 3
    rows = {i: (centres[i % 8] + rng.normal(size=16)).astype(np.float32).tolist() for i in range(600)}
    long = [4 * x for x in rows[100]]
    for i in range(100, 160):
        rows[i] = long  # copies: ties
    odd = [(601, None), (602, [0.0] * 16), (603, [1.0, None] + [0.0] * 14), (604, [float("nan")] * 16), (605, [float("inf")] * 16), (606, [1.0, 2.0]), (None, [1.0] * 16), (7, rows[7])]
    df = spark.createDataFrame([*rows.items(), *odd], "vec_id long, embedding array<float>")
    index = ann.TreeIndex(df, leaf=16, block=block)
    got = {}
    for r in index.search(index.rows.filter(F.col("vec_id") % 20 == 0)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = _exact(rows, [i for i in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want) and index.recall >= 0.9
    for q in want:
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and len(got[q]) == 20
        assert all(s == _product(rows[q], rows[i]) for i, s in got[q])
    assert [i for i, _ in got[100]] == list(range(101, 121))


def test_index_of_little(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.0, 1.0])], "vec_id long, embedding array<float>")
    index = ann.TreeIndex(df)
    got = [tuple(r) for r in index.search(index.rows.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 0.5), (0, 2, 21, 0.0), (20, 1, 0, 0.5), (20, 2, 21, 0.5)]
    assert ann.TreeIndex(df.filter("false")).n == 0


def test_repeated_ids_do_not_crowd_others_out():
    rng = np.random.default_rng(6)
    x_ids, x, q_ids, q = np.repeat(np.arange(40), 30), np.repeat(rng.normal(size=(40, 8)), 30, 0), np.arange(3), rng.normal(size=(3, 8))
    asks = rng.random((3, len(x))) < 0.5
    got = ann._best(q_ids, q, x_ids, x, 20, asks).to_pylist()
    for i in q_ids.tolist():
        scores = sorted(((-_product(q[i], x[30 * j]), j) for j in range(40) if j != i and asks[i, x_ids == j].any()))[:20]
        assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == i] == [(j, -s) for s, j in scores]


@pytest.mark.parametrize("block", [1, 7, 100])
def test_groups_of_leaves(block):
    sizes = np.random.default_rng(7).integers(0, 12, 50)
    of = ann.groups_of(sizes, block)
    assert of[0] == 0 and set(np.diff(of)) <= {0, 1}
    assert all(sizes[of == g].sum() <= block or (sizes[of == g] > 0).sum() == 1 for g in range(of[-1] + 1))


def test_long_vectors_are_found_first(spark):
    rng = np.random.default_rng(8)
    rows = {i: (rng.normal(size=12) * rng.lognormal(sigma=1.0)).tolist() for i in range(800)}
    index = ann.TreeIndex(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), leaf=16)
    assert index.recall >= 0.9 and index.n_visits <= index.tree.n_leaves // 2
    found = {(r["query_id"], r["vec_id"]) for r in index.search(index.rows.filter("vec_id % 20 = 0")).collect()}
    want = _exact(rows, [i for i in rows if i % 20 == 0], 20)
    assert sum((q, i) in found for q in want for i, _ in want[q]) >= 0.9 * 20 * len(want)


def test_small_leaves_do_not_shorten_answers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[0] * 50 + rng.normal(size=8) * 0.01).tolist()) for i in range(1, 400)] + [(1000, [-50.0] + [0.0] * 7), *[(1001 + i, (np.eye(8)[1] * 50 + rng.normal(size=8)).tolist()) for i in range(3)], (1001, (np.eye(8)[1] * 51).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = ann.TreeIndex(df, leaf=16)
    index.n_visits = 1
    got = {r["query_id"]: r["count"] for r in index.search(index.rows.filter("vec_id >= 1000")).groupBy("query_id").count().collect()}
    assert got == dict.fromkeys((1000, 1001, 1002, 1003), 20)


def test_repeated_ids_ask_with_their_least_vector(spark):
    rng = np.random.default_rng(3)
    v = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    twice = [(0, [5.0] + [0.0] * 7), (0, [-5.0] + [0.0] * 7)]
    for rows in (v[1:] + twice, twice[::-1] + v[1:]):
        index = ann.TreeIndex(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        got = index.search(index.rows.filter("vec_id = 0")).orderBy("rank").collect()
        want = sorted(((-5.0 * x[0], i) for i, x in v[1:]), key=lambda p: (-p[0], p[1]))[:20]
        assert [r["vec_id"] for r in got] == [i for _, i in want]

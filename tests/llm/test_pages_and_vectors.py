"""HTML extraction, URL filters and nearest neighbours."""

import pickle
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweir.llm import ann, html, urls

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B</h1></header><p>First <b>bold</b>word&nbsp;here<br>next   line<p>Second &lt;tag&gt; &#233;
<ul><li>one<li>two</ul><form><p>Subscribe</p></form><div class="ad">Buy</div><div class="share-buttons">Share</div><!-- <p>hidden</p> -->
<table><tr><td>a</td><td>b</td></tr></table><section id="comments"><article><p>Reader says</p></article></section><footer>By me</footer></article>
<aside><p>Related</p></aside><footer>Foot</footer></body></html>"""
WANT = "A & B\n\nFirst boldword here next line\n\nSecond <tag> é\n\none\n\ntwo\n\na b"


def test_article():
    assert html.main_text(html.parse(PAGE), set()) == WANT


@pytest.mark.parametrize("source", ["", "plain", "<", "<p", "<p>a", "</p></div>", "<script>x", "<!-- open", "<a <b>c", "<p>" * 3000, "<div>" * 400 + "x", "<title>t", "&#xD800;&bad;", "<p a='>'>q</p>", "<!-->x<!--->y", "</>", "</ x>y", "<!>", "<p/><p/ a", "<b><p>x</b>y"])
def test_any_input(source):
    text = html.main_text(html.parse(source), set())
    assert isinstance(text, str)
    text.encode("utf-8", "surrogatepass")


def test_raw_text_and_quotes():
    assert html.main_text(html.parse("<article><p title='a > b'>x</p><script>if (a < b) { '</p>' }</script>y</article>"), set()) == "x\n\ny"
    assert html.main_text(html.parse("<p>plain</p>"), set()) == "plain"
    assert html.main_text(html.parse('<div class="page with-sidebar no-ads"><article>a</article><div class="site_notice">n</div></div>'), set()) == "a"
    assert html.main_text(html.parse("<main><p>m</p></main><p>out</p>"), set()) == "m"
    assert html.main_text(html.parse("<main><h1>t</h1><p>by me</p><article>a</article><article>b</article></main>"), set()) == "t\n\na\n\nb"
    assert html.main_text(html.parse("""<article><p title="it's>hello</p><p a=b">x</p></article>"""), set()) == "x"  # as HTML reads it: the value ends at the next quote
    assert html.main_text(html.parse("""<article><p title="it's>hello</p><p>x</p></article>"""), set()) == "hello\n\nx"
    assert html.main_text(html.parse("<p>a<!-->b<!-- c --!>d</p><p"), set()) == "abd"


LONG = {"quotes": '<p a="', "names": "<a ", "depth": "<div>x", "open": "<b>", "ends": "<div></x>", "items": "<ul><li>", "comments": "<!--", "raw": "<script>", "attributes": '<div class="a" ', "blanks": "<a   ", "less": "<"}


@pytest.mark.parametrize("kind", LONG)
def test_long_pages_take_linear_time(kind):
    def seconds(size):
        source = LONG[kind] * (size // len(LONG[kind]))
        source += "<p>end</p>" * (size // 50 if kind == "open" else 1)
        began = time.process_time()
        page = html.parse(source)
        html.subtrees(page), html.frames(page), html.main_text(page, {1})
        return time.process_time() - began

    # four times the page in about four times the time, whatever the machine
    small, large = (min(seconds(n) for _ in range(2)) for n in (100_000, 400_000))
    assert large < 9 * max(small, 0.02)


@pytest.mark.parametrize("outer", ['class="content-with-sidebar"', 'class="post-related-layout"', 'id="comments-disabled-post"'])
def test_names_do_not_empty_a_page(spark, outer):
    page = lambda i: f'<div>Top</div><div {outer}><p>Body number {i} is here, w{i} v{i} x{i}.</p><div class="sidebar">Links</div></div><div class="related">More</div>'
    assert html.main_text(html.parse(f"<div {outer}><p>Body text here.</p></div>"), set()) == "Body text here."
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)]
    out = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Body number {r['page_id']} is here, w{r['page_id']} v{r['page_id']} x{r['page_id']}." for r in out)


def test_names_still_drop_what_is_beside_the_text():
    page = '<div><p>The body of the page.</p></div><div id="comments"><p>Somebody says more than that, and at some length.</p></div>'
    assert html.main_text(html.parse(page), set()) == "The body of the page."


def test_site_templates(spark):
    rng = random.Random(1)
    say = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(20))
    page = lambda body, extra="": f"<body><div>Top of the site</div>{extra}<div><p>{body}</p></div><div>Bottom</div></body>"
    rows = [(i, f"http://a.example/{i}", page(b := say())) for i in range(12)]
    bodies = {r[0]: r[2].split("<p>")[1].split("</p>")[0] for r in rows}
    rows += [(100 + i, "http://b.example/", page("the same words", "<div>x</div>")) for i in range(20)]
    rows += [(200, None, page("no host")), (201, "http://c.example", None), (202, "http://c.example", ""), rows[0]]
    passage = " ".join(f"long{i}" for i in range(60))  # a passage that pages share is no notice
    rows += [(300 + i, f"http://d.example/{i}", f"<article><div>Share this now</div><p>We changed our terms.</p><p>{passage}</p><p>{say()}</p></article>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.main_texts(df.selectExpr("*", "1 AS text", "2 AS host")).collect()}
    assert all(got[i]["text"] == b for i, b in bodies.items())
    assert "the same words" in got[100]["text"]  # copies of one page make no template
    assert got[200]["text"] == "Top of the site\n\nno host\n\nBottom"
    assert got[201]["text"] == got[202]["text"] == "" and got[201]["n_chars"] == 0
    assert all(got[300 + i]["text"].startswith(passage + "\n\n") for i in range(8))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.main_texts(df).count() == len(rows)
    assert html.main_texts(df.limit(0)).count() == 0


def plain_pages(n, rng):
    """Pages whose names tell nothing: (page, article) with a menu, a promotion and a credit line of ever other words."""
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    for _ in range(n):
        title, body = say(4), [say(30) for _ in range(rng.randrange(1, 6))]
        text = "".join(f"<p>{x}</p>" for x in body)
        yield f'<body><div class="x{rng.randrange(9)}"><ul><li>{say(1)}</li><li>{say(1)}</li></ul></div><div class="q"><h1>{title}</h1>{text}<div>Read our letter</div></div><div class="r">{say(3)}</div><table><tr><td>{say(2)}</td></tr></table></body>', "\n\n".join([title, *body])


def test_templates_alone(spark):
    """Where no name tells, what recurs by its words or by its shape goes, and the article stays whole."""
    rng = random.Random(4)
    made = list(plain_pages(30, rng))
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    assert all(html.main_text(html.parse(p), set()) != text for p, text in made)
    got = {r["page_id"]: r["text"] for r in html.main_texts(df).collect()}
    assert [got[i] for i in range(30)] == [text for _, text in made]


def test_given_pages_need_no_names(spark):
    """With every name and class taken away, templates alone find the articles of the given pages."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(article|nav|footer|aside|header|main)", "<$1div"), ' class="[^"]*"', ""))
    want = {r["page_id"]: r["text"] for r in html.main_texts(pages).collect()}
    got = {r["page_id"]: r["text"] for r in html.main_texts(bare).collect()}
    assert len(got) == 2500 and all(want.values())
    assert sum(got[i] == t for i, t in want.items()) >= 2475


def test_host_counts(spark):
    """Templates of texts are what a count of pages by distinct articles says."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        host = rng.choice("abc")
        rows.append((f"{host}.example", "".join(f"<div>{rng.choice(['menu', 'more', 'top', 'end', 'few'] + [str(rng.random())] * 3)}</div>" for _ in range(3)) + f"<p>{rng.randrange(40)}</p>"))
    pages, trees = defaultdict(set), defaultdict(set)
    for host, source in rows:
        page = html.parse(source)
        sign = html.main_text(page, set())
        pages[host].add(sign)
        for i, h in html.subtrees(page):
            trees[host, h, page.elements[i].tag in html.PROSE].add(sign)
    want = defaultdict(set)
    for (host, h, prose), signs in trees.items():
        if len(signs) >= max(html.LEAST_PAGES, len(pages[host]) * (html.PROSE_SHARE if prose else html.LEAST_SHARE)):
            want[host].add(h)
    got = html.host_templates(spark.createDataFrame(rows, "host string, html string")).collect()
    assert {r["host"]: {h for h in r["templates"] if h >= 0} for r in got} == want


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://example.com/en/1", "https://WWW.Example.com/en/x?y=/es/", "http://a.b.net/es/", "http://net/fr/", "ftp://xnet/es/", "http://shop.com", "http://shop.com/?q", "nothing", "", None, "http://", "://x.com/a", "http://a.com://b/c", "http://é.com/ü", "http://x.org:80/en/#f", "http://notexample.com/en/", "http://example.com\n/en/"]


def test_urls(spark, sf_dir):
    pages = spark.createDataFrame(list(enumerate(URLS * 2)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS verdict")
    got = {r["page_id"]: r for r in urls.judge(pages, urls.rules_table(spark)).collect()}
    assert len(got) == len(URLS) * 2
    for i, u in enumerate(URLS * 2):
        rule, verdict = rule_of(*parts(u))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*parts(u), rule)
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0), urls.rules_table(spark)).count() == 0
    assert {r["rule"] for r in urls.judge(pages, urls.rules_table(spark).limit(0)).collect()} == {None}
    assert urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.rules_table(spark)).count() == 50


def test_trees_learn(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        host = ("cheap-pills-" + str(rng.randrange(9999)) + ".example") if bad else ("".join(rng.choice("abcdefgh") for _ in range(8)) + ".example")
        rows.append((i, f"http://{host}/p/{rng.randrange(999)}" + ("?a=1&b=2&c=3" if bad else ""), int(bad)))
    df = urls.parsed(spark.createDataFrame(rows, "page_id long, url string, blocked int"))
    model = urls.train(df.filter("page_id < 600"))
    got = model.blocked(df.filter("page_id >= 600").select("url", "host", "path", "blocked")).collect()
    assert np.mean([(r["p_block"] >= 0.5) == bool(r["blocked"]) for r in got]) > 0.97


def test_sides_are_broadcast_after_a_count(spark, monkeypatch):
    df = spark.range(20).withColumnRenamed("id", "k")
    joined = lambda: df.join(urls.beside(df), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined()
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 19)
    assert "SortMergeJoin" in joined() and "Broadcast" not in joined()


def test_suffixes_do_not_decide(spark):
    """Verdicts of pages without a rule vary within a suffix, and no suffix statistic carries the trees."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rules = urls.rules_table(spark)
    free = urls.judge(pages, rules).filter("rule IS NULL").groupBy(F.substring_index("host", ".", -1).alias("tld")).agg(F.countDistinct("p_block").alias("scores"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count("*").alias("n")).collect()
    assert {r["tld"] for r in free} == {"net", "org"} and all(r["scores"] > 5 and 0 < r["blocked"] < r["n"] for r in free)
    model = urls.train(urls.labelled_by_rules(pages, rules))
    parts = model.importances()
    assert sum(parts.values()) == pytest.approx(1) and sum(parts[k] for k in urls.SUFFIX_FEATURES) < 0.5
    accuracy, area = urls.held_out(urls.labelled_by_rules(pages, rules))
    assert accuracy > 0.6 and area > 0.6


def exact(rows, k=5):
    """query -> (id, cosine) of the k nearest vectors of its length, in rows of (id, vector)."""
    fine = [(i, ann.scaled(np.array([v], float))[0]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % 50 == 0:
            near = {}
            for j, v in fine:
                if j != i and len(v) == len(q):
                    near[j] = max(near.get(j, -2), round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9))
            out.setdefault(i, []).extend((-s, j) for j, s in near.items())
    best = {i: sorted({j: s for s, j in sorted(xs, reverse=True)}.items(), key=lambda x: (x[1], x[0]))[:k] for i, xs in out.items()}
    return {i: [(j, -s) for j, s in xs] for i, xs in best.items() if xs}


def found(df):
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    return sum(len({j for j, _ in got[q]} & {j for j, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 400)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # ties, queries among them
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8), (2200, [1.0, 2.0]), (2201, [2.0, 1.0]), (2300, [7.0]), (2250, []), (None, rows[0][1]), rows[100], rows[100], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "1 AS part", "2 AS h1", "3 AS ids")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, got = exact(rows), found(df)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    scores = {(q, j): s for q, near in exact(rows, 10**6).items() for j, s in near}
    for q, near in got.items():
        assert len(near) == len(want[q]) and near == sorted(near, key=lambda x: (-round(x[1], 9), x[0]))
        assert all(s == pytest.approx(scores[q, j], abs=1e-8) for j, s in near)
    assert [j for j, _ in got[1000]] == [50, 1001, 1002, 1003, 1004] and got[2200] == [(2201, pytest.approx(0.8))]
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id = 50")).count() == 0
    assert ann.nearest(df.filter("vec_id IN (50, 51, 52)")).count() == 2
    same = found(spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [1.0, 0.1]), (52, [0.1, 2.0])], "vec_id long, embedding array<double>"))
    assert [j for j, _ in same[50]] == [52, 51]


def test_components_of_any_size(spark):
    rows = [(50, [1e200, 1e200]), (51, [1e200, 0.0]), (52, [1e-200, 1e-200]), (53, [1.0, 1.0]), (54, [5e-324, 0.0]), (55, [-1.7e308, 1.7e308])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [j for j, _ in got[50]] == [52, 53, 51, 54, 55]
    assert [s for _, s in got[50]] == pytest.approx([1, 1, 0.5**0.5, 0.5**0.5, 0])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_vectors(spark, sf):
    """The partition is in use on tables of any size, and finds what brute force finds."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    levels, index = ann.build(ann.distinct_vectors(ann.usable(df), 5, 50))
    router = pickle.loads(levels[0][0].first()["router"])
    assert 2 <= router.probes < router.parts == index.select("part").distinct().count()
    want = exact([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    assert recall(found(df), want) >= 0.95


@pytest.mark.parametrize("routers", [ann.ROUTERS, 0])
def test_parts_of_parts(spark, monkeypatch, routers):
    monkeypatch.setattr(ann, "BLOCK", 200)
    monkeypatch.setattr(ann, "LARGE", 900)
    monkeypatch.setattr(ann, "PARTS", 4)
    monkeypatch.setattr(ann, "ROUTERS", routers)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 9000)] + rng.normal(size=(9000, 16))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    levels, index = ann.build(ann.distinct_vectors(ann.usable(df), 5, 50), 2000)
    sizes = [r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(levels) >= 2 and len(sizes) > 8 and max(sizes) <= 900 and sum(sizes) == 9000
    assert all(r["part"].count("/") >= 1 for r in index.select("part").distinct().collect())
    assert pickle.loads(levels[0][0].first()["router"]).probes < 4
    assert recall(found(df), exact(rows)) >= 0.9


def test_balance():
    rng = np.random.default_rng(2)
    x = ann.unit(rng.normal(size=(1000, 8)))
    graph = ann.neighbour_graph(x, 5)
    part = ann.balanced_parts(x, graph, 7)
    assert np.bincount(part, minlength=7).max() <= 1000 / 7 * 1.1 + 1
    shuffled = rng.permutation(part)
    assert (part[graph] == part[:, None]).mean() > 2 * (shuffled[graph] == shuffled[:, None]).mean()

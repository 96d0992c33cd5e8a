import re

from memlayer.llm import html_text as h

SCHEMA = "page_id long, url string, html string, text string, keys string"


def page(article, footer="f", before=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>menu</a></ul></nav>{before}<!-- c --><article>{article}</article><footer>{footer}</footer></body></html>"


CASES = [
    (page("<h1>Title</h1><p>one <b>two<br><p>three&amp;four  five</p>"), "Title one two three&four five"),
    (page("<p>a</p><div class='ad-box ad'>buy</div><section id=comments><p>first!</p></section><aside>x</aside><form>q<input></form><p>b</p>"), "a b"),
    (page("<p>x<script>1<2</script>y&nbsp;&#233;&lt;z</p>"), "xy é<z"),
    ("<body><header>H</header><div role=navigation>n</div><p hidden>no</p><p>yes<p>and<div style='display: none'>no</div> more</body>", "yes and more"),
    ("<article><p>cut of", "cut of"),
    ("plain &amp text", "plain & text"),
    ("<p title='a>b'>in</p> <p title=\"un>closed>still", "in closed>still"),
    ("<!-- never closed <p>x</p>", ""),
    ("<script>never closed <p>x</p>", ""),
    ("", ""),
    (None, ""),
    ("<main><article><p>a</p></article><article class=comment>c</article></main><p>out</p>", "a"),
    ("<b>" * 20000 + "deep", "deep"),
    ("<div>" * 5000 + "deep", "deep"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.example/x", s, "t", "k") for i, (s, _) in enumerate(CASES)], SCHEMA)
    out = {x.page_id: x.text for x in h.extract_text(df).collect()}
    for i, (s, want) in enumerate(CASES):
        assert out[i] == want, (s, out[i])
    assert h.extract_text(df.limit(0)).count() == 0


def site(spark):
    """One host without article marks: a box and a note recur; copies of one page count once."""
    rows = [(i, "https://A.example/p", f"<body><div><p>Site box, all rights</p></div><p>own words {i}</p><p>Site note</p></body>", "t", "k") for i in range(12)]
    rows += [(100 + i, "https://b.example/p", "<body><div><p>same page</p></div></body>", "t", "k") for i in range(30)]
    rows += [(200 + i, "https://c.example/p", page(f"<p>lead {i}</p><p>a licence line</p><ul><li>share this</li></ul>"), "t", "k") for i in range(8)]
    return spark.createDataFrame([*rows, (300, None, "<p>no url</p>", None, None), (None, "x", "<p>y</p>", None, None), (5, "https://A.example/p", None, None, None)], SCHEMA).repartition(3)


def test_recurring_subtrees_are_deleted_by_host(spark, monkeypatch):
    for limit in (h.BROADCAST, -1):  # -1: the joined form
        monkeypatch.setattr(h, "BROADCAST", limit)
        out = [(x.page_id, x.text) for x in h.extract_text(site(spark)).collect()]
        want = [(i, f"own words {i}") for i in range(12)] + [(100 + i, "same page") for i in range(30)] + [(200 + i, f"lead {i} a licence line") for i in range(8)] + [(300, "no url"), (None, "y"), (5, "")]
        assert sorted(out, key=str) == sorted(want, key=str)


def varied(i, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()):
    """A page whose menu, advert and footer differ in their words on every page, and whose article holds a long notice."""
    import random

    r = random.Random(i)
    pick = lambda k: " ".join(r.choices(words, k=k))
    menu = "".join(f"<li><a href='/{w}'>{w}{i}</a></li>" for w in r.choices(words, k=r.randrange(4, 9)))
    own = [pick(r.randrange(5, 60)) for _ in range(r.randrange(1, 6))]
    notice = "<div class='x9'><p>" + "All rights are with the makers of this site and its readers. " * 12 + "</p></div>"
    article = f"<h1>{pick(4)} {i}</h1>" + "".join(f"<p>{p}</p>" for p in own[:1]) + notice + "".join(f"<p>{p}</p>" for p in own[1:])
    html = f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='top'><ul>{menu}</ul></div><div class='q7'>{pick(9)}</div><div class='story'>{article}</div><div class='end'>(c) {pick(5)}</div></body></html>"
    return html, " ".join([re.search("<h1>(.*?)</h1>", html)[1], *own])


def test_templates_alone_find_what_differs_in_words(spark):
    """No tag, class or article mark helps here: shapes and bytes counted by host carry the result."""
    pages = [(i, "https://v.example/p", *varied(i)) for i in range(40)]
    df = spark.createDataFrame([(i, u, s) for i, u, s, _ in pages], "page_id long, url string, html string").repartition(3)
    for how in ({"rules": False, "bound": False}, {}):
        out = {x.page_id: x.text for x in h.extract_text(df, **how).collect()}
        assert all(out[i] == want for i, _, _, want in pages)


def test_counts_equal_brute_force(spark):
    """Templates by plain dictionaries over every page of a table, then each page without them."""
    from collections import defaultdict

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    rows += [(10**6 + i, "https://v.example/p", varied(i)[0]) for i in range(8)] + [(10**6 + 50 + i, "https://v.example/p", varied(1)[0]) for i in range(9)]
    come, whole, shapes = defaultdict(set), defaultdict(set), defaultdict(dict)
    for _, url, source in rows:
        page = h.Page(source or "", h._host(url), rules=False, bound=False)
        whole[h._host(url)].add(page.text)
        for key in page.hashes + list(page.shapes):
            come[h._host(url), key].add(page.text)
        for key, (n, linked) in page.shapes.items():
            old = shapes[key].get(page.text, (0, 0))
            shapes[key][page.text] = (max(n, old[0]), max(linked, old[1]))
    poor = {k: 2 * sum(x[1] for x in v.values()) >= sum(x[0] for x in v.values()) or sum(x[0] - x[1] for x in v.values()) <= h.POOR * len(v) for k, v in shapes.items()}
    known = {key for (host, key), texts in come.items() if len(texts) >= 5 and (key not in shapes or 2 * len(texts) >= len(whole[host]) and poor[key])}
    df = spark.createDataFrame([tuple(x) for x in rows], "page_id long, url string, html string").repartition(4)
    found = h.templates(h.subtrees(df, rules=False, bound=False))
    assert {x.key % (1 << 64) for x in found.collect()} == known
    got = {x.page_id: x.text for x in h.extract_text(df, rules=False, bound=False).collect()}
    assert all(got[i] == h.Page(source or "", h._host(url), known, rules=False, bound=False).text for i, url, source in rows)


def test_the_main_text_of_a_like_page_stays(spark):
    """Pages of one shape throughout: what holds most of the text is no template."""
    rows = [(i, "https://w.example/p", f"<body><div class='m'><a href='/'>home {i}</a></div><div class='c'><p>some text {i} of this page that is long</p></div></body>") for i in range(20)]
    out = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=False).collect()
    assert all(x.text == f"some text {x.page_id} of this page that is long" for x in out)


def blocks(i, count, kind, wrapped):
    """A page without any helpful mark: a heading and an article in ``count`` like blocks, under a menu and over a changing footer."""
    import random

    r = random.Random(100 * i + count)
    words = [" ".join(f"{r.choice('abcdefgh')}{r.randrange(10**4)}" for _ in range(r.randrange(12, 40))) for _ in range(count)]
    body = {
        "div": "".join(f"<div class='sec'><p>{w}</p></div>" for w in words),
        "section": "".join(f"<section class='card'><h3>{w.split()[0]}</h3><p>{w}</p></section>" for w in words),
        "table": "".join(f"<table class='t'><tr><td>{w}</td></tr></table>" for w in words),
        "list": "".join(f"<ul class='l'><li>{w}</li></ul>" for w in words),
    }[kind]
    want = f"Head {i} " + " ".join(f"{w.split()[0]} {w}" if kind == "section" else w for w in words)
    body = f"<div class='wrap'>{body}</div>" if wrapped else body
    menu = "".join(f"<a href='/{k}'>m{r.randrange(99)}</a>" for k in range(5))
    return f"<html><body><div class='m'>{menu}</div><h1>Head {i}</h1>{body}<div class='e'>(c) {r.randrange(10**6)} all rights</div></body></html>", want


def test_like_blocks_of_an_article_stay(spark):
    pages, want = [], {}
    for n, (count, kind, wrapped) in enumerate((c, k, w) for c in range(1, 11) for k in ("div", "section", "table", "list") for w in (False, True)):
        for i in range(20):
            source, want[1000 * n + i] = blocks(i, count, kind, wrapped)
            pages.append((1000 * n + i, f"https://h{n}.example/p", source))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    for how in ({}, {"rules": False, "bound": False}):
        wrong = [x.page_id for x in h.extract_text(df, **how).collect() if x.text != want[x.page_id]]
        assert not wrong, wrong[:9]

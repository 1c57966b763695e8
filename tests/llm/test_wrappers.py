import html
import re

from telerisk.llm import wrappers as W

SHELL = """<!DOCTYPE html><html><head><title>{t} - Site</title><style>p{{margin:0}}</style><script>var a = "</p><p>x";</script></head><body>
<div class="site-header"><a href="/">Home</a> <span>{date}</span></div><ul class="main-menu"><li>One<li>Two {date}</ul>
<div id="wrap"><div class="left-sidebar"><p>Latest {date} news</p></div>
<div class="post"><h2>{t}</h2><p>First&nbsp;&amp; {a}<br>line <p>Second <b>{b}</b> para <div class="cookie-notice">We use {date} cookies</div>
<ul><li>item {a}<li>item two</ul><p>Share this article</p><form><input><button>Send {b}</button></form></div>
<section class="comments"><p>Reader {b} says</p></section></div><!-- <p>gone</p> --><footer>&copy; {date}</footer></body></html>"""


def shell(i):
    v = {"t": f"Title {i}", "a": f"alpha{i} " * (i % 3 + 1), "b": f"beta{i}", "date": f"day {i}"}
    want = [v["t"], f"First & {v['a'].strip()} line", f"Second {v['b']} para", f"item {v['a'].strip()}", "item two"]
    return SHELL.format(**v), want


def test_wrapper_of_a_host(spark):
    data, want = [], {}
    for i in range(12):
        page, blocks = shell(i)
        data.append((i, f"https://user@News.example.org:80/{i}", page))
        want[i] = "\n\n".join(blocks)
    rows = W.main_text(spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS wrapper")).collect()
    # 'item two' and the sharing line are the same on all exemplars of this host, so they are template
    got = {r.page_id: r.text for r in rows}
    assert got == {i: w.replace("\n\nitem two", "") for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_single_page_keeps_all_blocks(spark):
    page, blocks = shell(3)
    got = W.extract(page, None)
    assert got == "\n\n".join([*blocks, "Share this article"])


def article(page):
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", m[1]))
    return "\n\n".join(b for b in blocks if b)


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in W.main_text(pages).collect()} == truth


def test_edges(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    odd = [None, "", "   ", "plain text only", "<p>a<p>b", "<p>unclosed <b>x", "<script>never", "<!-- open", "<a <b> x", "&lt;p&gt;&am &#233;", deep, "<p>same</p>", "<p>same</p>",
           "<table><tr><td>a<td>b<tr><td>c</table>", "<p>x</p>" * 3000]
    rows = [(i, None if i % 2 else "not a url", h) for i, h in enumerate(odd)] + [(None, "http://h/", "<p>z</p>")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[0] == text[1] == text[2] == text[6] == text[7] == ""
    assert W.extract("plain text only", None) == "plain text only" and W.extract(odd[4], None) == "a\n\nb" and W.extract(odd[9], None) == "<p>&am é"
    assert W.extract(deep, None) == "core" and W.extract(odd[13], None) == "a b\n\nc" and W.extract(odd[14], None).count("x") == 3000
    assert W.main_text(pages.limit(0)).count() == 0


BODY = "".join(f"<p>Paragraph {k} of the article with some words</p>" for k in range(9))
PARAGRAPHS = "\n\n".join(f"Paragraph {k} of the article with some words" for k in range(9))


def test_class_names_of_states_and_holders_drop_nothing():
    for name in ("no-sidebar", "has-sidebar", "ad-free", "post-share-enabled", "content-sidebar-wrap"):
        for tag in ("body", "article", "main", "div"):
            page = f'<html><body><ul class="main-menu"><li>Home</ul><{tag} class="{name}">{BODY}</{tag}><div class="sidebar">Latest</div></body></html>'
            assert W.extract(page, W.induce([page])) == PARAGRAPHS, (name, tag)
    page = f'<body><div class="entry">{BODY}</div><section class="comments"><article class="comment">{BODY * 4}</article></section></body>'
    assert W.extract(page, None) == PARAGRAPHS
    page = f'<main><article class="post share-open">{BODY}</article><article class="related">Other</article></main>'
    assert W.extract(page, None) == PARAGRAPHS


def test_pages_that_do_not_fit_the_wrapper(spark):
    first = [f'<body><div class="top">Site</div><div class="wrap"><div class="teaser">short {i}</div></div></body>' for i in range(30)]
    second = f'<body><div class="top">Site</div><div class="wrap"><div class="lead">in short</div><div class="story">{BODY}</div></div></body>'
    assert W.extract(second, W.induce(first[:8])) == W.extract(second, None) and W.extract(second, None).endswith(PARAGRAPHS)
    assert W.extract(second, W.induce([*first[:4], second])) == W.extract(second, None)
    data = [(i, f"http://h.example/{i}", p) for i, p in enumerate([*first, second])]
    got = {r.page_id: r.text for r in W.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[30].endswith(PARAGRAPHS) and got[7] == "short 7"


def test_deep_elements_close_only_themselves():
    for depth in (100, 146, 148, 150, 200, 2000):
        inner = "<div>" * depth + "<p>deep one</p><p>deep two</p><nav><p>menu</p></nav>" + "</div>" * depth
        page = f'<body><div class="menu">x</div><div class="content"><p>start</p>{inner}{BODY}</div><footer>end</footer></body>'
        assert W.extract(page, None) == "start\n\ndeep one\n\ndeep two\n\n" + PARAGRAPHS, depth


def test_constant_lines_and_long_lists():
    flat = [f"<body><p>Our site</p><p>text {i}</p><p>more {i}</p><p>again {i}</p><p>All rights reserved</p></body>" for i in range(3)]
    wrappers = W.induce(flat)
    assert [W.extract(p, wrappers) for p in flat] == [f"text {i}\n\nmore {i}\n\nagain {i}" for i in range(3)]
    long = [f"<body><div class='nav'>m</div>{'<div>ad</div>' * 300}<div class='story'>{''.join(f'<p>w{i} {k}</p>' for k in range(2000))}</div></body>" for i in range(3)]
    wrappers = W.induce(long)
    assert W.extract(long[1], wrappers).split("\n\n")[-2:] == ["w1 1998", "w1 1999"] and "ad" not in W.extract(long[1], wrappers)


def best_alignment(a, b):
    """All order-keeping alignments, by plain recursion over the children."""
    if a.tag != b.tag:
        return 0.0

    def pairs(x, y):
        if not x or not y:
            return 0.0
        w = best_alignment(x[0], y[0])
        return max(pairs(x[1:], y), pairs(x, y[1:]), w + pairs(x[1:], y[1:]) if w else 0.0)
    return W.alike(a, b) + pairs(a.children, b.children)


def test_matching_equals_brute_force():
    import random
    rng = random.Random(5)

    def tree(depth):
        node = W.Node(rng.choice("ab"), rng.choice(["", "x", "y"]))
        node.parts = [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        return node
    for _ in range(150):
        a, b = tree(2), tree(2)
        weight, pairs = W.matching(a, b, W.alike)
        assert weight == best_alignment(a, b) and weight == sum(W.alike(x, y) for x, y in pairs)

"""HTML extraction: the deduced template decides, against brute force and on pages without article or main."""

import random
import time
from collections import defaultdict

import pytest

from kinema.llm import html

PAGE = "<html><body><div>{chrome}</div><article><h1>Title {i}</h1><div><span>Read this before you go on</span></div><p>Text of page {i}</p>{more}<p>Shared by the shop</p></article></body></html>"
#: Layouts of hosts, none with an article or main element: what is constant, what isn't, and the text wanted.
LAYOUTS = {
    "div.com": ("<div id=w><div class=hd>Daily paper</div><div class=story><h2>Head {i}</h2><p>Story {i} is here</p><p>With {i} parts</p></div><div class=bt>Write to us</div></div>", "Head {i} Story {i} is here With {i} parts"),
    "table.com": ("<table><tr><td>Shop<td>Basket is empty</table><table><tr><td>Item {i}<td>Costs {i} coins</table><p>Terms of sale", "Item {i} Costs {i} coins"),
    "teaser.com": ("<div class=story><p>Real text {i}</p></div><aside><article><p>teaser</p></article></aside><div><article><p>Read our best</p></article></div>", "Real text {i}"),
}


def frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_template_inside_article(spark):
    pages = [(i, f"http://a.com/{i}", PAGE.replace("{i}", str(i)).replace("{chrome}", "top").replace("{more}", "<p>More</p>" * (i % 3))) for i in range(9)]
    copy = "<html><body><div>{i}</div><main><p>The one text</p><p>of a host of copies</p></main></body></html>"
    pages += [(100 + i, f"http://c.com/{i}", copy.replace("{i}", str(i))) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract_main_text(frame(spark, pages)).collect()}
    for i in range(9):
        words = got[i].split()
        assert "Read" not in words and "Shared" not in words and "top" not in words, got[i]
        assert got[i].startswith(f"Title {i} Text of page {i}")
        assert html.main_text(pages[i][2], set()) != got[i]
    assert all(got[100 + i] == f"{i} The one text of a host of copies" for i in range(6))


def test_pages_without_article(spark):
    pages, want = [], {}
    for k, (host, (page, text)) in enumerate(LAYOUTS.items()):
        for i in range(7):
            pages.append((100 * k + i, f"http://{host}/{i}", f"<html><body>{page}</body></html>".replace("{i}", f"n{i}")))
            want[100 * k + i] = text.replace("{i}", f"n{i}")
    got = {r.page_id: r.text for r in html.extract_main_text(frame(spark, pages)).collect()}
    assert got == want
    assert all(html.main_text(p, set()) != want[i] for i, _, p in pages)


def brute_templates(pages):
    """(host, tokens) by whole vectors, nesting by repeated passes, and orders compared pair by pair."""
    hosts = defaultdict(dict)
    lists = defaultdict(list)
    for _, url, page in pages:
        host = url.split("://")[1].split("/")[0]
        rows, content = html.occurrences(page)
        for h in (host, ""):
            lists[h].append([r["token"] for r in rows])
            held = hosts[h].setdefault((host, content), {})
            for r in rows:
                n, parent = held.get(r["token"], (0, r["parent"]))
                held[r["token"]] = max(n, r["n"]), parent
    out = {}
    for host, found in hosts.items():
        vectors, parents = defaultdict(dict), {}
        for page, rows in found.items():
            for token, (n, parent) in rows.items():
                vectors[token][page] = n
                parents[token] = parent
        classes = defaultdict(list)
        for token, v in vectors.items():
            if len(v) >= max(html.LEAST_PAGES, html.FREQUENT * len(found)):
                classes[tuple(sorted(v.items()))].append(token)
        known = {t for c in classes.values() for t in c}
        classes = [c for c in classes.values() if all(parents[t] in known or parents[t] == html.ROOT for t in c)]
        valid = [c for c in classes if len({tuple(t for t in x if t in c) for x in lists[host]} - {()}) == 1]
        if valid:
            out[host] = {t for c in valid for t in c}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = ["<p>Buy now</p>", "<div class=x><p>Same</p></div>", "<ul><li>one<li>two</ul>", "<h2>Top</h2>", "<p>Last</p>"]
    pages = []
    for k in range(40):
        host = rng.choice(["a.com", "a.com", "b.com", "c.org"])
        some = [x for x in parts if rng.random() < 0.8]
        if rng.random() < 0.3:
            rng.shuffle(some)
        own = [f"<p>own words {rng.randint(0, 30)} of this page alone</p>" for _ in range(2)]
        pages.append((k, f"http://{host}/{k}", "<html><body>" + "".join([*some[:2], *own, *some[2:]]) + "</body></html>"))
    got = {r.host: set(r.tokens) for r in html.templates(frame(spark, pages)).collect()}
    assert got == brute_templates(pages)
    # the template leaves out classes whose members change places
    orders = [(i, f"http://o.com/{i}", f"<p>own words of {i} come first</p>" + ("<p>A</p><p>B</p>" if i % 2 else "<p>B</p><p>A</p>")) for i in range(8)]
    text = {r.page_id: r.text for r in html.extract_main_text(frame(spark, orders)).collect()}
    assert text[1].endswith("A B") and text[2].endswith("B A")


def test_broken_pages_take_linear_time():
    for page in ("<div><p>x" * 20_000, "<section>" * 20_000 + "</article>" * 20_000, "<p><div>" + "<span>" * 20_000 + "</p>" * 20_000, "x" * 1_000_000):
        start = time.time()
        html.main_text(page, set())
        assert time.time() - start < 10


ARTICLE = "<h1>Title</h1><p>" + "The article says a lot of things here. " * 5 + "</p>"
TEXT = "Title " + ("The article says a lot of things here. " * 5).strip()


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="has-sidebar"><article>{ARTICLE}</article></body>',
        f'<html class="no-js no-cookies"><body>{ARTICLE}</body></html>',
        f'<body><div class="content with-sidebar">{ARTICLE}</div></body>',
        f'<body><article class="post related-post">{ARTICLE}</article></body>',
        f'<body><main id="skip-target">{ARTICLE}</main></body>',
        f'<body><div class="sidebar-layout">{ARTICLE}</div><div class="sidebar">Links</div></body>',
        f'<body><div class="sidebar">Links</div><div class="menu-page">{ARTICLE}<div class="share">Share</div></div></body>',
        f'<body><div class="content sidebar-page"><article>{ARTICLE}</article><div class="sidebar">Links</div></div></body>',
        f'<body><article>{ARTICLE}</article><section class="comments"><article class="comment-body">{"A reader comments. " * 90}</article></section></body>',
        f'<body><div class="post">{ARTICLE}</div><div class="comments"><p>{"A reader comments. " * 20}</p></div></body>',
        f'<body><nav>Menu</nav><main>{ARTICLE}<div class="newsletter">{"Subscribe! " * 80}</div></main><footer>End</footer></body>',
    ],
)
def test_class_words_never_take_the_page(page):
    assert html.main_text(page, frozenset()) == TEXT


def test_marks_take_linear_time():
    began = time.time()
    assert html.main_text('<div class="sidebar">a' * 40_000, frozenset()) != "" and time.time() - began < 20

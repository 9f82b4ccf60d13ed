"""Main text of pages, and the window sums against their definition."""

import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from vaultferry.llm import html_text as ht

LONG = "A sentence of the article that is long enough to make a surge of the text density. " * 2
BOX = "Text of a box around the article, also rather long, so that length alone says nothing. " * 2

CASES = [
    ("", ""),
    ("plain text", "plain text"),
    ("<script>x</script><!-- <p>y</p> --><style>p{}</style>", ""),
    (f"<nav>{BOX}</nav><p>{LONG}</p><footer>{BOX}</footer>", LONG.strip()),
    (f"<div class='side bar'>{BOX}</div><div><h1>Head</h1><p>{LONG}<p>End.</div>", f"Head {LONG.strip()} End."),
    (f"<div id=comments><p>{BOX}</div><main><p>{LONG}</main><aside>{BOX}</aside>", LONG.strip()),
    (f"<div class='page with-sidebar'><p>{LONG}</p></div>", LONG.strip()),
    (f"<article><h1>T</h1><p>a&nbsp;&amp;\n\t b &#233;&eacute;</p><div class=ad>{BOX}</div><p>c</article>", "T a & b éé c"),
    (f"<article class=comment><p>{BOX}</p></article><article><p>x</article>", "x"),
    (f'<p title="a > b">{LONG}</p><form><label>{BOX}</label><input value="v"></form>', LONG.strip()),
    (f"<p>{LONG}<br>line<br/>two <b>bold</b>ly</p><iframe>{BOX}</iframe>", f"{LONG.strip()} line two boldly"),
    (f"<table><tr><td>{LONG}<td>cell</table><p hidden>{BOX}</p>", f"{LONG.strip()} cell"),
    (f"<p>{LONG}</p><script>if (a < b) '</p>'", LONG.strip()),
    (f"<div class=sidebar><p>{LONG}</p></div>", LONG.strip()),  # nothing else is there
    ("<p>a<p>b < c and d > e</p>", "a b < c and d > e"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text(page, text):
    assert ht.main_text(page) == text


SHARE, AD = "<div class=share>Share this</div>", f"<div class=ad>{BOX}</div>"
HEAD, END = "<h1>Short title</h1>", "<p>Short end.</p>"
STORY = f"Short title {LONG.strip()} Short end."
CARD = "<article class=card><h3>Teaser</h3><p>A few words.</p></article>"
TEASER = f"<article class=card><p>{LONG}</p></article>"

WHOLE = [
    (f"<div>{HEAD}{SHARE}<p>{LONG}</p>{AD}{END}</div>", STORY),
    (f"<body>{HEAD}{SHARE}<p>{LONG}</p>{AD}{END}</body>", STORY),
    (f"<div>{HEAD}<button>Play</button><div><p>{LONG}</p></div><svg></svg><div>{END}</div></div>", STORY),
    (f"<div><div>{HEAD}</div>{AD}<div><p>{LONG}</p></div>{AD}<div>{END}</div></div>", STORY),
    (f"<div>{HEAD}{AD}<p>Few words.</p>{AD}{END}</div>", "Short title Few words. Short end."),
    # what lies outside the story's container needs a surge of its own
    (f"<div><p>Menu</p><p>Shop</p></div>{AD}<div>{HEAD}{SHARE}<p>{LONG}</p>{AD}{END}</div>", STORY),
    # the story is not in what is named an article
    (f"<div>{HEAD}{AD}<p>{LONG}</p>{AD}{END}</div>{CARD}{CARD}", STORY),
    (f"<div>{HEAD}<p>{LONG}</p>{CARD}{END}</div>", STORY),
    (f"{TEASER}<div>{HEAD}<p>{LONG}{LONG}</p>{AD}{END}</div>", f"{LONG.strip()} Short title {LONG}{LONG.strip()} Short end."),
    # it is
    (f"<div><p>{LONG}</p></div><article>{HEAD}<p>{LONG}{LONG}</p></article>{CARD}", f"Short title {LONG}{LONG.strip()}"),
    (f"<p>Few words.</p><article>{END}</article>", "Short end."),
]


@pytest.mark.parametrize("page,text", WHOLE)
def test_no_block_of_the_story_is_lost(page, text):
    assert ht.main_text(page) == text


NAMES = [
    "div class='overflow-hidden'",
    "div aria-hidden='false'",
    "div data-x='a hidden b' title='hidden'",
    "section id='discussion'",
    "section id='in-popular-culture'",
    "section id='art-form'",
    "div class='market-share-report'",
    "div class='layout sidebar-right'",
    "div class='sidebar'",
    "div class='post has-sidebar search-engines'",
]


@pytest.mark.parametrize("name", NAMES)
def test_names_that_hold_the_story(name):
    tag = name.split()[0]
    part = f"<{name}><p>{LONG}</p><p>More.</p></{tag}>"
    inside = f"{LONG.strip()} More."
    assert ht.main_text(f"<nav>{BOX}</nav>{part}<footer>x</footer>") == inside
    assert ht.main_text(f"<div>{HEAD}{part}{END}</div>") == f"Short title {inside} Short end."
    assert ht.main_text(f"<{name}><article>{HEAD}{part}</article></{tag}>") == f"Short title {inside}"


GONE = [
    "div hidden",
    "div class='hidden'",
    "div style='color:red; display: none'",
    "div aria-hidden=true",
    "div class='site-header'",
    "ul class='comment-list'",
    "div class='post related-posts'",
    "div id=cookie-banner",
    "div class=newsletter",
]


@pytest.mark.parametrize("name", GONE)
def test_names_of_parts_around(name):
    box = f"<{name}><p>{BOX}</p></{name.split()[0]}>"
    assert ht.main_text(f"<div>{HEAD}<p>{LONG}{LONG}</p>{box}{END}</div>") == f"Short title {LONG}{LONG.strip()} Short end."


def test_an_article_keeps_its_headline():
    page = f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By A. on Monday</p></header><p>{LONG}</p></article>"
    assert ht.main_text(page) == f"Title {LONG.strip()}"


def plain_main_lines(weights, used):
    """The definition, line by line."""
    n = len(weights)
    sums = [sum(weights[i : i + ht.WINDOW]) for i in range(n)]
    runs, i = [], 0
    while i < n:
        if not used[i]:
            i += 1
            continue
        end = i
        empty = 0
        for j in range(i, n):
            empty = 0 if used[j] else empty + 1
            if empty == ht.WINDOW:
                break
            if used[j]:
                end = j
        runs.append((i, end + 1))
        i = end + 1
    good = [r for r in runs if max(sums[r[0] : r[1]]) >= ht.SURGE]
    if not good and runs:
        good = [max(runs, key=lambda r: sum(weights[r[0] : r[1]]))]
    return [bool(used[i]) and any(a <= i < b for a, b in good) for i in range(n)]


def test_cuts_equal_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 40))
        used = rng.random(n) < rng.random()
        weights = np.where(used, rng.integers(0, 60, n), 0)
        assert ht.main_lines(weights, used).tolist() == plain_main_lines(weights.tolist(), used.tolist())


def test_surges_decide_on_pages_without_names(monkeypatch):
    """Real pages whose parts have no telling names: menus fall to the density alone."""
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    pages = [p for p in pq.read_table(path, columns=["html"]).column(0).to_pylist() if p]
    plain = [re.sub(r"(</?)(article|nav)\b", r"\1div", p) for p in pages]
    found = [ht.main_text(p) for p in plain]
    assert found == [ht.main_text(p) for p in pages]
    monkeypatch.setattr(ht, "main_lines", lambda weights, used: used.copy())
    assert sum(ht.main_text(p) != f for p, f in zip(plain, found)) > len(pages) / 2


def test_window_sums():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 57):
        weights = rng.integers(0, 200, n)
        want = [weights[i : i + ht.WINDOW].sum() for i in range(n)]
        assert ht.block_sums(weights).tolist() == want


def test_very_long_and_deep_pages():
    page = "<div>" * 3000 + "".join(f"<p>{LONG}{n}</p>" for n in range(3000)) + "</div>" * 3000
    assert len(ht.main_text(page)) == sum(len(f"{LONG}{n}".strip()) + 1 for n in range(3000)) - 1


def test_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, f"<p>{LONG}</p>"), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = ht.page_texts(pages.selectExpr("*", "'x' as text", "1 as n_chars")).collect()
    want = [(1, "u", "", 0), (1, "u", "", 0), (None, None, LONG.strip(), len(LONG.strip())), (3, "v", "", 0)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert ht.page_texts(pages.limit(0)).collect() == []

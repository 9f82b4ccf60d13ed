"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text is never part of the article.
HIDDEN = frozenset(
    "script style noscript template svg math head title iframe object canvas audio video".split()
)
AROUND = frozenset(
    "nav header footer aside form menu dialog button select option textarea label fieldset".split()
)
# Elements that begin a new line of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu "
    "nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that hold blocks of text: the story lies in one of them.
CONTAINERS = frozenset("article center div main section table td th".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr keygen frame".split()
)
# Elements a new one of these kinds closes, as authors leave out the end tags.
SELF_CLOSING = frozenset("p li dt dd tr td th option thead tbody".split())
# Class tokens, ids and roles that mark a part around the article, whatever its length.
NOTES = frozenset(
    "ad ads advert adverts advertisement advertising nav navbar navigation menu breadcrumb "
    "breadcrumbs cookie cookies consent gdpr comment comments reply replies disqus pagination "
    "pager skip".split()
)
# Those that only do so for a part which is not the story itself.
HINTS = frozenset(
    "sponsor sponsored promo promoted promotion banner sidebar side rail widget widgets footer "
    "header masthead notice notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations trending "
    "popular respond toolbar complementary contentinfo search form".split()
)
# Words that may join one of these in a name such as "site-header" or "comment-list".
JOINED = frozenset(
    "site page main top bottom left right list box bar buttons button links posts section wrapper "
    "wrap container block slot area items icons inner outer primary secondary global sticky".split()
)
# Tokens of an element that lays out the page, whose other tokens say what lies beside it.
FRAMES = frozenset("layout page wrapper container content row columns grid site story".split())
ROLES = frozenset("article main".split())
# A first word that makes a name speak of the page's layout, such as "with-sidebar".
LAYOUT = frozenset("with without has no".split())
# Lines per window and characters a window needs to count as a surge.
WINDOW = 3
SURGE = 80

# Raw text elements end at their own end tag only; comments may hold markup.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN_BY = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
HIDDEN_AS = re.compile(
    r"aria-hidden\s*=\s*[\"']?true\b|style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none", re.IGNORECASE
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")


def marked(rest: str) -> str:
    """What the names of an element say: "note", "hint", or nothing.

    Whole tokens count, and compounds of which every word is known; a word within another name
    says nothing.
    """
    found = ""
    for m in NAMED.finditer(rest):
        tokens = (m[1] or m[2] or m[3] or "").lower().split()
        if not FRAMES.isdisjoint(tokens):
            continue
        for token in tokens:
            words = re.split(r"[_-]+", token)
            if words[0] in LAYOUT or not all(w in NOTES or w in HINTS or w in JOINED for w in words):
                continue
            if not NOTES.isdisjoint(words):
                return "note"
            if not HINTS.isdisjoint(words):
                found = "hint"
    return found


def is_hidden(rest: str) -> bool:
    """Whether an element is not shown: by the attribute, a style, or a class of that name."""
    if "hidden" not in rest.lower() and "display" not in rest.lower():
        return False
    if HIDDEN_BY.search(QUOTED.sub('""', rest)) or HIDDEN_AS.search(rest):
        return True
    return any("hidden" in (m[1] or m[2] or m[3] or "").lower().split() for m in NAMED.finditer(rest))


@dataclass
class Page:
    """Lines of a page and the tree of its containers, numbered as they open; 0 is the page.

    A line has its text, characters outside links, the number of its outermost article (0 if
    it is in none) and its container.
    """

    lines: list[tuple[str, int, int, int]] = field(default_factory=list)
    # Characters outside links in all, in articles, and likewise in each part that is a hint.
    total: list[int] = field(default_factory=lambda: [0, 0])
    hints: list[list[int]] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])
    articles: list[bool] = field(default_factory=lambda: [False])


def lines_of(page: str, notes: bool = True, hints: frozenset[int] | None = None) -> Page:
    """Lines of a page and their containers.

    Markup is stripped; a part around the article leaves empty lines, as many as a window
    is long, so that text on its two sides never meets in one window. Inside an article such
    a part is just left out; of an article's own header the headings stay. ``notes`` tells
    whether classes, ids and roles are regarded, ``hints`` which of the parts with a hint, in
    page order, are left out (none if not given).
    """
    found = Page()
    lines = found.lines
    # Element, around, article, container, number of its hint (-1: none), header of an article.
    stack: list[tuple[str, bool, bool, bool, int, bool]] = []
    text: list[str] = []
    plain = 0
    around = article = links = holder = named = headers = heads = 0

    def close_line() -> None:
        nonlocal plain
        joined = SPACE.sub(" ", "".join(text)).strip()
        if joined:
            lines.append((joined, plain, named if article else 0, holder))
        text.clear()
        plain = 0

    def gap() -> None:
        close_line()
        if not article:
            lines.extend([("", 0, 0, holder)] * WINDOW)

    def leave() -> str:
        nonlocal around, article, links, holder, headers, heads
        name, was_around, was_article, was_container, hint, was_header = stack.pop()
        if was_around:
            text.clear()
            around -= 1
            if not around:
                gap()
        elif name in BLOCKS and not around:
            close_line()
        if was_article:
            close_line()
            article -= 1
        if was_container:
            holder = found.parents[holder]
        if was_article:
            gap()
        links -= name == "a"
        headers -= was_header
        heads -= name in HEADINGS
        if hint >= 0:
            before, part = found.hints[hint], found.total
            found.hints[hint] = [part[0] - before[0], part[1] - before[1]]
        return name

    def add(raw: str) -> None:
        nonlocal plain
        if raw and not around and (heads or not headers):
            piece = html.unescape(raw)
            text.append(piece)
            if not links:
                size = len(piece.strip())
                plain += size
                found.total[0] += size
                found.total[1] += size if article else 0

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name, rest = name.lower(), m["rest"]
        if m["end"]:
            if any(s[0] == name for s in stack):
                while leave() != name:
                    pass
            elif name in BLOCKS and not around:
                close_line()
            continue
        if name in SELF_CLOSING:
            open_names = [s[0] for s in stack]
            if name in open_names:
                last = len(open_names) - 1 - open_names[::-1].index(name)
                if all(
                    n == name or n not in BLOCKS or n in SELF_CLOSING for n in open_names[last:]
                ):
                    while leave() != name:
                        pass
        if name in BLOCKS and not around:
            close_line()
        if name in VOID or rest.endswith("/"):
            continue
        is_article = name in ROLES or ("role" in rest and re.search(r"role=\W?(main|article)", rest))
        is_header = name == "header" and article > 0 and not around
        hint, is_around = -1, (name in AROUND or name in HIDDEN) and not is_header
        if rest and notes and name not in ("html", "body", "main"):
            said = "note" if is_hidden(rest) else marked(rest)
            if said == "hint":
                hint = len(found.hints)
                found.hints.append(found.total.copy())
            is_around |= said == "note" or (hints is not None and hint in hints)
        if is_article and not around:
            gap()
            named += not article
            article += 1
        if is_around:
            if not around:
                gap()
            around += 1
        links += name == "a"
        is_article = bool(is_article and not around)
        is_container = not around and (name in CONTAINERS or is_article)
        if is_container:
            found.parents.append(holder)
            found.articles.append(is_article)
            holder = len(found.parents) - 1
        headers += is_header
        heads += name in HEADINGS
        stack.append((name, is_around, is_article, is_container, hint, is_header))
    add(page[at:])
    while stack:
        leave()
    close_line()
    return found


def block_sums(weights: np.ndarray) -> np.ndarray:
    """Characters of the window of ``WINDOW`` lines that begins at each line."""
    total = np.concatenate(([0], np.cumsum(weights), np.full(WINDOW - 1, weights.sum())))
    return total[WINDOW:] - total[:-WINDOW]


def main_lines(weights: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Marks of the lines between a surge and the following dive of the window sums.

    A stretch reaches from the dive before (the last empty window) to the dive after, so the
    short lines at the edges of an article belong to it. Stretches without a surge are
    dropped, unless none has one: then the one with most text is kept. ``used`` marks lines
    with any text.
    """
    keep = np.zeros(len(weights), bool)
    if not used.any():
        return keep
    sums = block_sums(weights)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], used.view(np.int8), [0]))))
    stretches: list[list[int]] = []
    for start, end in edges.reshape(-1, 2):
        # Fewer empty lines than a window between two stretches are no dive.
        if stretches and start - stretches[-1][1] < WINDOW:
            stretches[-1][1] = int(end)
        else:
            stretches.append([int(start), int(end)])
    chosen = [s for s in stretches if sums[s[0] : s[1]].max() >= SURGE]
    if not chosen:
        chosen = [max(stretches, key=lambda s: int(weights[s[0] : s[1]].sum()))]
    for start, end in chosen:
        keep[start:end] = used[start:end]
    return keep


def story_lines(
    page: Page, weights: np.ndarray, used: np.ndarray, within: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the lines to keep, and of those among them in the container of the surge.

    The container of the surge is the innermost one with more than half of the text that
    surges. Of its lines all that ``within`` marks are kept, whatever was left out between
    them. The page itself, or a container around a surge of one wrapped line, also holds the
    parts around the story: of these only their own blocks are kept, a wrapped line being one.
    """
    keep = main_lines(weights, used)
    holders = np.array([h for _, _, _, h in page.lines], np.int64)
    size = len(page.parents)
    held = np.bincount(holders, weights * keep, size)
    count = np.bincount(holders, used, size)
    for h in range(size - 1, 0, -1):  # a container comes after the one around it
        held[page.parents[h]] += held[h]
        count[page.parents[h]] += count[h]
    if not held[0]:
        return keep, keep
    home = int(np.flatnonzero(2 * held > held[0])[-1])
    block = [h > 0 and count[h] == 1 and not page.articles[h] for h in range(size)]
    whole = home > 0 and not block[home]
    while block[home]:
        home = page.parents[home]
    inside = np.zeros(size, bool)
    inside[home] = True
    for h in range(home + 1, size):
        inside[h] = inside[page.parents[h]] and (whole or block[h])
    story = used & inside[holders] & (keep | within)
    return keep | story, story


def noted_lines(page: str) -> Page:
    """Lines of a page without the parts that names mark as lying around the article.

    A hint does not hold for a part with more than half of the text in articles, or of all
    text where none is in an article: that part is the story.
    """
    found = lines_of(page)
    if not found.hints:
        return found
    article = found.total[1] > 0
    whole = found.total[article]
    return lines_of(
        page, hints=frozenset(n for n, h in enumerate(found.hints) if 2 * h[article] <= whole)
    )


def main_text(page: str) -> str:
    """Text of the article, its blocks joined by one space; empty if there is none.

    Where the page names its article, only lines inside it count, unless a longer surge lies
    outside: then what is named so are teasers, which count only if they surge themselves.
    """
    found = noted_lines(page)
    used = np.array([bool(line[0]) for line in found.lines], bool)
    if not used.any():  # names that mark parts around an article mark everything here
        found = lines_of(page, notes=False)
        used = np.array([bool(line[0]) for line in found.lines], bool)
        if not used.any():
            return ""
    plain = np.array([line[1] for line in found.lines], np.int64)
    named = np.array([line[2] for line in found.lines], np.int64)
    outside = used & (named == 0)
    inside = used & (named > 0)
    if inside.any() and outside.any():
        _, story = story_lines(found, plain * outside, outside, outside)
        surges = block_sums(plain * outside).max() >= SURGE
        if not surges or (plain * story).sum() <= np.bincount(named, plain * inside).max():
            used = outside = inside
    elif inside.any():
        outside = inside
    keep, _ = story_lines(found, plain * used, used, outside)
    return " ".join(found.lines[i][0] for i in np.flatnonzero(keep))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def page_texts(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages(page_id, url, html)``: ``page_id, url, text, n_chars``.

    The whole page is read, however long or broken its markup. Null and empty pages and
    pages without text have an empty text. Rows that repeat a page are answered each. An
    empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")

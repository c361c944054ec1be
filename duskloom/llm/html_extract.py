"""Main text of web pages by line-block distribution (Chen, 2010), over the page's own block structure.

Markup is stripped and every block element gives one line. A line weighs as many characters as it has of its own text; a line in an element
that markup names as no part of an article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) weighs nothing, and
where a page has an article element, only lines in one weigh. Weights are summed over a sliding window of lines. Text starts at a surge,
where a window's sum reaches the page's threshold, and ends at the dive, where a window has nothing; all lines between that are no boilerplate
stay, however short they are.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Lines of a window; characters in a window from which text starts on a page without an article element.
WINDOW, SURGE = 3, 86

#: Share of a line's characters in links from which it weighs nothing there.
LINKS = 0.5

#: Share of a page's largest stretch of text that another stretch must have to stay, on a page without an article element.
LEAST_SHARE = 0.1

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no markup, and those whose text is never a page's.
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
_UNSEEN = frozenset((*_RAW, "noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "select", "button", "datalist", "map", "head"))
_ASIDE = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "search", "header"))
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Parts of an article that keep their text whatever their name says.
_NEVER = frozenset(("html", "body", "article", "main", "p", *_HEADINGS, "b", "i", "em", "strong", "a", "code", "blockquote", "table", "tbody", "tr", "td"))

_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "note"))
_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar masthead header footer foot sidebar sidenav "
    "aside widget widgets related recommended recommendations recirculation outbrain taboola share sharing social follow comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice notices "
    "alert notification newsletter subscribe subscription signup login popup modal overlay pagination pager paging copyright legal disclaimer skip search searchform form tags tagcloud trending popular teaser".split()
)
#: An element that names itself the article's heading part.
_OF_ARTICLE = frozenset(("article", "entry", "post", "story", "content"))
_WITHOUT = frozenset(("no", "has", "with", "without", "hide", "show"))

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?](?:[^>]*>|.*)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</[^>]*>|<(?P<bad>/?[A-Za-z][^\s/>]*)[^>]*(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I) for name in _RAW}


class Line(NamedTuple):
    """A block's text with single blanks, its characters in links, whether its element is no part of an article, whether it is in an
    article element, and whether it is a heading."""

    text: str
    linked: int
    aside: bool
    main: bool
    heading: bool


def _named_aside(name: str, more: str, in_main: bool) -> bool:
    """Whether an element's name, role, class or id says that it is no part of an article."""
    if name == "header":
        return not in_main
    if name in _ASIDE:
        return True
    if not more or name in _NEVER and name not in ("p", "table"):
        return False
    found = {key.lower(): a or b or c for key, a, b, c in _ATTRIBUTE.findall(more)}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in _ROLES:
        return True
    for own in (*found.get("class", "").split(), found.get("id", "")):
        words = [w.lower() for w in _NAME_PARTS.findall(own)]
        for i, word in enumerate(words):
            if word in _NAMES and not (i and words[i - 1] in _WITHOUT) and not (word == "header" and (in_main or _OF_ARTICLE & set(words[:i]))):
                return True
    return False


def lines_of(html: str | None) -> list[Line]:
    """A page's blocks with text, in order; a null page has none."""
    found: list[Line] = []
    parts: list[str] = []
    opened: list[tuple[str, bool, bool, bool, bool]] = []  # name, aside, unseen, main, heading
    state = ("", False, False, False, False)
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Line(text, min(linked, len(text)), *(state[1], state[3], state[4])))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not state[2]:
            text = unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    html, at = html or "", 0
    while (tag := _TAG.search(html, at)) is not None:
        add(html[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or tag["bad"] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA[") and not state[2]:
                parts.append(" ")
            continue
        closing, name = bool(tag["close"]) or name[0] == "/", name.lstrip("/")
        if name == "br" or name == "wbr" and not closing:
            parts.append(" " if name == "br" else "")
            continue
        if name in _BLOCKS:
            flush()
            links = 0
        elif name == "a":
            links = 0 if closing else 1
        if closing:
            place = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == name), None)
            if place is not None:
                del opened[place:]
                state = opened[-1] if opened else ("", False, False, False, False)
            continue
        if name in _RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in _VOID or (tag["more"] or "").endswith("/") and name not in _BLOCKS:
            continue
        if name == "body":
            opened, state = [], ("", False, False, False, False)
        if name == "p":  # a paragraph ends where the next begins
            while opened and opened[-1][0] not in _BLOCKS:
                opened.pop()
            if opened and opened[-1][0] == "p":
                opened.pop()
            state = opened[-1] if opened else ("", False, False, False, False)
        if name in _BLOCKS or name in _UNSEEN or (tag["more"] or "").strip():
            main = state[3] or name in _MAIN and not state[1]
            state = (name, state[1] or _named_aside(name, tag["more"] or "", state[3]), state[2] or name in _UNSEEN, main, state[4] or name in _HEADINGS)
            opened.append(state)
    add(html[at:])
    flush()
    return found


def text_places(weights: np.ndarray, surge: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Half-open stretches of lines from a surge, the first line with weight of a window whose sum reaches the threshold, to the dive, the last
    line with weight before a window without any."""
    n = len(weights)
    sums = np.convolve(weights, np.ones(window))[window - 1 :] if n else np.zeros(0)  # each line's and the next ones'
    found, at = [], 0
    while at < n:
        up = at + np.flatnonzero(sums[at:] >= surge)
        if not len(up):
            break
        first = int(up[0]) + int(np.flatnonzero(weights[up[0] :])[0])
        down = first + np.flatnonzero(sums[first:] == 0)
        end = int(down[0]) if len(down) else n
        last = first + int(np.flatnonzero(weights[first:end])[-1]) + 1
        found.append((first, last))
        at = max(end, last)
    return found


def main_text(html: str | None, window: int = WINDOW) -> str:
    """A page's main text, its blocks joined by line feeds; empty for a null or empty page and one without an article."""
    lines = lines_of(html)
    marked = any(x.main and not x.aside for x in lines)
    size = np.array([0 if x.aside or marked and not x.main else len(x.text) for x in lines], float)
    if marked:
        places = text_places(size, 1, window)
    else:
        heads = np.array([x.heading for x in lines], bool)
        dense = np.array([x.linked < LINKS * len(x.text) for x in lines], bool)
        weights = np.where(dense, size, 0)
        sums = np.convolve(weights, np.ones(window)) if len(lines) else np.zeros(1)
        places = text_places(weights, max(min(SURGE, sums.max()), 1), window)
        held = [weights[a:b].sum() for a, b in places]
        places = [(a, b) for (a, b), n in zip(places, held, strict=True) if n >= LEAST_SHARE * max(held)]
        places = [(a - 1 if a and heads[a - 1] and size[a - 1] else a, b) for a, b in places]
    return "\n".join(lines[i].text for a, b in places for i in range(a, b) if size[i])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages (page_id, url, html).

    A null or empty html, and one without text, gives an empty text; broken markup is read as far as it goes; repeated rows give equal rows;
    an empty table gives none; other columns aren't read. n_chars counts code points.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        return pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(own, work, "page_id long, url string, text string, n_chars long")


#: The same for pages like those of the given tables: one article element that holds only paragraphs, headings and the references named here.
ORACLE = r"""
WITH cut AS (SELECT row_number() OVER () AS k, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
blocks AS (SELECT k, unnest(string_split_regex(body, '</?(p|h1)>')) AS raw, unnest(range(1, len(string_split_regex(body, '</?(p|h1)>')) + 1)) AS i FROM cut),
plain AS (
  SELECT k, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(raw, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS line FROM blocks
),
joined AS (SELECT k, string_agg(line, chr(10) ORDER BY i) AS text FROM plain WHERE line <> '' GROUP BY k)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM cut LEFT JOIN joined USING (k)
"""

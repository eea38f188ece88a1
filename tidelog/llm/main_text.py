"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Lines inside menus, forms, adverts
and the like, and lines that are mostly links, count as empty. The distribution is the
text length summed over a sliding window of lines: the text surges where a window rises above a
threshold and dives where windows become empty (Chen, General web page extraction based on
line-block distribution, 2009). Everything between a surge and its dive is main text. Lines in
<article> or <main> weigh more by a bonus below the threshold, and text that surged in there has to surge
anew where the element ends; else all pages and lines are decided alike.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and names (class, id, role) of what is no main text. Fixed values.
DROPPED = frozenset("nav aside footer form menu dialog button label input select option datalist fieldset head title".split())
# Their content is no text. Without an end tag, that of ENDLESS reaches to the end of the page, others are tags like any.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea audio video select".split())
ENDLESS = frozenset(["script", "style"])
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side ad ads adv advert adverts advertisement advertising sponsor sponsored"
    " promo promotion banner cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login"
    " comment comments commentlist respond replies reply discussion disqus share sharing social related recommended recommendations pagination pager"
    " footer masthead toolbar widget search contentinfo complementary".split()
)
OUTSIDE = frozenset(["header"])  # dropped unless inside the article
ARTICLE = frozenset(["article", "main"])
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A new one ends an open one of its kind: paragraphs end at any block, items at the next item.
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

# Alternatives exclude each other and give nothing back, so a tag is read in one pass: a quote that none follows is a character
# like any, and where the rest of the page lies in quotes the tag ends at the next ">".
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?:(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|(?P<open>[^>]*+)>)",
    re.IGNORECASE | re.DOTALL,
)
# What begins behind the last ">" of a page and is cut off by its end.
CUT_OFF = re.compile(r"<[/!?]?(?:[a-z!-].*)?\Z", re.IGNORECASE | re.DOTALL)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class LineBlockRule:
    """Windows of ``window`` lines surge at ``least`` characters; a line is a menu entry with at least ``links`` of its text in links.
    Other lines in an article count as ``bonus`` characters more. Where nothing surges, the page's own densest windows set the
    threshold, if a line has ``words`` words: a short text is kept, a lone word is none."""

    window: int = 3
    least: int = 80
    links: float = 0.5
    bonus: int = 40
    words: int = 3


def _dropped(tag: str, rest: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag in OUTSIDE and not in_article):
        return True
    if tag in ARTICLE or tag in ("html", "body") or "=" not in rest:
        return False
    for groups in NAMED.findall(rest):
        for name in "".join(groups).lower().split():
            words = WORD.findall(name)
            if words and (words[0] in NAMES or words[-1] in NAMES or (words[-1] in OUTSIDE and not in_article)):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool, int]]:
    """Lines in page order: text, in an article, dropped, characters in links."""
    lines: list[tuple[str, bool, bool, int]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open element, dropped inside, article inside
    opened: Counter[str] = Counter()  # open elements by name

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def end_line() -> None:
        nonlocal linked
        dropped, article = state()
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, article, dropped, linked))
        parts.clear()
        linked = 0

    def close(upto: int) -> None:
        if any(t in BLOCKS for t, _, _ in stack[upto:]):
            end_line()
        opened.subtract(t for t, _, _ in stack[upto:])
        del stack[upto:]

    at, in_link = 0, 0
    unended: set[str] = set()  # raw elements without an end tag in the rest of the page
    last = page.rfind(">") + 1  # no tag ends beyond
    while m := TOKEN.search(page, at, last):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            linked += len(text.strip()) if in_link else 0
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag, rest = tag.lower(), m["open"] if m["rest"] is None else m["rest"]
        if tag in RAW and not m["end"] and tag not in unended and (tag in ENDLESS or not rest.endswith("/")):
            end = RAW_END[tag].search(page, at)
            if end or tag in ENDLESS:
                at = end.end() if end else len(page)
                continue
            unended.add(tag)
        if tag == "br":
            parts.append(" ")
        if m["end"]:
            in_link -= tag == "a" and in_link > 0
            if opened[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            elif tag in BLOCKS:
                end_line()
            continue
        if tag in BLOCKS:
            end_line()
            for i in range(len(stack) - 1, -1, -1):
                kind = stack[i][0]
                if kind == "p" or tag in CLOSED_BY.get(kind, ()):
                    close(i)
                    break
                if kind in BLOCKS and kind not in CLOSED_BY:
                    break
        in_link += tag == "a"
        if tag in VOID or rest.endswith("/"):
            continue
        dropped, article = state()
        article = article or tag in ARTICLE
        inside = dropped or _dropped(tag, rest, article)
        # Elements inside a line matter only if they are dropped.
        if tag in BLOCKS or inside != dropped:
            if inside != dropped and tag not in BLOCKS:
                end_line()
            stack.append((tag, inside, article))
            opened[tag] += 1
    parts.append(CUT_OFF.sub("", page[at:]))
    end_line()
    return lines


def main_text(page: str | None, rule: LineBlockRule = LineBlockRule()) -> str:
    lines = lines_of(page) if page else []
    size = np.array([0 if dropped or linked >= rule.links * len(t) > 0 else len(t) + rule.bonus * article for t, article, dropped, linked in lines], np.int64)
    if not len(size):
        return ""
    total = np.concatenate([[0], np.cumsum(size)])
    stop = np.minimum(np.arange(len(size)) + rule.window, len(size))
    block = total[stop] - total[:-1]
    least = rule.least
    if block.max() < least:
        if not any(n and len(t.split()) >= rule.words for (t, *_), n in zip(lines, size.tolist(), strict=True)):
            return ""
        least = block.max()
    kept: list[str] = []
    inside = in_article = False  # of a run of main text; it surged in an article
    for (text, article, dropped, _), n, own in zip(lines, block.tolist(), size.tolist(), strict=True):
        if inside and (not n or (in_article and not article)):
            inside = False  # dive
        if not inside and own and n >= least:
            inside, in_article = True, article  # surge
        if inside and not dropped:
            kept.append(text)
    return "\n".join(kept)


def extract_pages(pages: DataFrame, rule: LineBlockRule = LineBlockRule(), key: str = "page_id", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: its columns but ``page``, and text, n_chars. Null and empty pages have
    the empty text. A page may end anywhere, also inside a tag, which is then no text. A row's own columns ``text`` and ``n_chars`` give way to the new ones."""
    others = [c for c in pages.columns if c not in (page, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), rule) for x in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*others, "text", "n_chars"])

    types = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others]
    return pages.select(*others, page).mapInArrow(run, ", ".join([*types, "text string", "n_chars long"]))

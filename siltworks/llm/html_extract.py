"""Main text of web pages: the maximum-scoring contiguous region of a page's words and tags.

A word scores -log P(outside) and a tag log P(inside), so words score positive and tags negative (the tags that an
element outside holds cost nothing more). Both probabilities are learnt from labelled
pages, for each kind of element: what a page holds within its elements of that kind is main text or not. A word or tag counts by the most
telling element around it, so a menu costs much and its words bring nothing, while paragraphs bring much and cost little. One
linear scan then finds the contiguous region of the highest sum. Elements within the region that are rather outside the main text (an advert
between paragraphs) lower its sum, and are left out of it.

An element's kind is the parts of its class, id and role, if it has any that is known, and else its name. Where labelled pages don't say
enough, PRIOR does: it counts as so many more elements outside, or inside, and gives way to what the pages show.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, whole

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and never text of the page.
RAW = frozenset("script style noscript template textarea svg iframe title".split())
#: Names of elements, and words of class, id and role, that are usually outside the main text.
USUAL_NAMES = frozenset("nav aside footer header form menu dialog button select option label fieldset head".split())
USUAL_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist discussion disqus replies respond reply form search pagination pager widget skip copyright complementary contentinfo".split()
)
#: Names of elements that are usually inside it, if nothing around them is outside.
USUAL_TEXT = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6".split())
#: How many elements on its side a usual name counts as, and as how many of each side any kind counts.
PRIOR, UNKNOWN = 20.0, 0.5
MAIN = frozenset(("article", "main"))
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A tag without a `<` or `>` within quotes, which is nearly all; others are read by quotes.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+|'[^'<>]*+'[^<>\"']*+)*+)>")
OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
PLAIN = re.compile(r"[^<>=]*+")
VALUE = re.compile(r"=\s*+([\"'])?")


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """The page as ("text", text, ""), ("open", name, attributes) and ("close", name, ""). Comments, declarations and raw elements are passed over.

    Every character is read a bounded number of times. What is cut off by the end is as browsers have it: an open comment, declaration or raw
    element takes the rest of the page; a tag that another `<` or the end cuts off is text.
    """
    at, n, never = 0, len(page), set()

    def find(what: str, start: int) -> int:
        """As str.find; what isn't found once is not looked for again."""
        if what in never:
            return -1
        got = page.find(what, start)
        if got < 0:
            never.add(what)
        return got

    while at < n:
        lt = find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            mark = "-->" if page.startswith("<!--", lt) else ">"
            end = find(mark, lt + (4 if mark == "-->" else 1))
            if end < 0:
                return
            at = end + len(mark)
            continue
        m = TAG.match(page, lt)
        if m:
            slash, name, rest, at = m[1], m[2].lower(), m[3], m.end()
        else:
            o = OPEN.match(page, lt)
            end = o.end() if o else lt + 1
            while o and end < n:
                end = PLAIN.match(page, end).end()
                if page[end : end + 1] != "=":
                    break
                v = VALUE.match(page, end)
                end = v.end()
                if v[1]:
                    end = max(end, find(v[1], end) + 1)
            if not o or page[end : end + 1] != ">":
                yield "text", page[lt:end], ""
                at = end
                continue
            slash, name, rest, at = o[1], o[2].lower(), page[o.end() : end], end + 1
        if name in RAW and not slash and not rest.endswith("/"):
            c = None if name in never else CLOSE[name].search(page, at)
            if not c:
                return
            at = c.end()
            continue
        yield ("close" if slash else "open"), name, rest


def kinds(name: str, rest: str, in_main: bool) -> list[str]:
    """The kinds of an element: the parts of its class, id and role, marked by a dot, and its name."""
    found = [p.lower() for m in ATTRIBUTE.finditer(rest) for p in PART.findall(m[1] or m[2] or m[3] or "")] if rest and name not in ("body", "html") else []
    if rest and "hidden" in rest.lower().split():
        found.append("hidden")
    return [f".{w}" for w in dict.fromkeys(found)] + ["inner-header" if name == "header" and in_main else name]


class Page:
    """A page's elements, (kinds, parent); its tokens, (number of words, or 0 for a tag; element); and its stretches of text, (text, element,
    index of the first token from there on, block)."""

    def __init__(self, page: str):
        self.elements: list[tuple[list[str], int]] = [([], -1)]
        self.tokens: list[tuple[int, int]] = []
        self.stretches: list[tuple[str, int, int, int]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        inside: Counter = Counter()
        block = 0
        for what, name, rest in pieces(page):
            if what == "text":
                raw = html.unescape(name)
                self.stretches.append((raw, stack[-1][1], len(self.tokens), block))
                if n := len(raw.split()):
                    self.tokens.append((n, stack[-1][1]))
                continue
            if name == "br":
                self.stretches.append((" ", stack[-1][1], len(self.tokens), block))
                continue
            block += name in BLOCKS
            if what == "close":
                self.tokens.append((0, stack[-1][1]))
                if inside[name]:
                    last = ""
                    while last != name:
                        last, _ = stack.pop()
                        inside[last] -= 1
                continue
            self.elements.append((kinds(name, rest, bool(inside["article"] or inside["main"])), stack[-1][1]))
            self.tokens.append((0, len(self.elements) - 1))
            if name not in VOID and not rest.endswith("/"):
                stack.append((name, len(self.elements) - 1))
                inside[name] += 1


def usual(kind: str) -> bool:
    """Whether a kind is usually outside the main text."""
    return kind[1:] in USUAL_WORDS if kind[0] == "." else kind in USUAL_NAMES


def learnt(labelled: Iterable[str]) -> dict[str, float]:
    """P(outside) of each kind of element, from labelled pages: those that mark their main text with one article element.

    Every element within it is one inside, but for usual furniture and what that holds, which the label can't mean. Of what is outside, only
    outermost elements count, as these, and not the lists and links that they hold, are why it is.
    """
    inside, outside = Counter(), Counter()
    for text in labelled:
        page = Page(text)
        mains = [i for i, (k, _) in enumerate(page.elements) if "article" in k]
        if len(mains) != 1:
            continue
        around, at = set(), mains[0]
        while at >= 0:
            around.add(at)
            at = page.elements[at][1]
        place = [""] * len(page.elements)  # in, out, or neither
        for i, (k, parent) in enumerate(page.elements):
            if i in around:
                continue
            if parent == mains[0] or place[parent] == "in":
                place[i] = "" if any(map(usual, k)) else "in"
                inside.update(k if place[i] else ())
            elif parent in around:
                place[i] = "out"
                outside[next((x for x in k if usual(x)), k[0])] += 1
    return {k: chance(k, inside[k], outside[k]) for k in inside | outside}


def chance(kind: str, inside: int = 0, outside: int = 0) -> float:
    """P(outside) of a kind of which so many elements are inside and outside."""
    low, high = inside + PRIOR * (kind in USUAL_TEXT) + UNKNOWN, outside + PRIOR * usual(kind) + UNKNOWN
    return high / (low + high)


def outside_odds(page: Page, learned: Mapping[str, float]) -> tuple[list[float], list[bool]]:
    """P(outside) of each element: of the most telling kind around it, and a half where nothing is known; and whether it is within another
    that is rather outside."""
    out: list[float | None] = []
    for k, parent in page.elements:
        named = [learned.get(x, chance(x) if usual(x) or x in USUAL_TEXT else None) for x in k]
        own = max((p for p in named[:-1] if p is not None), default=named[-1] if named else None)
        above = out[parent] if parent >= 0 else None
        out.append(own if above is None else above if own is None else max(own, above))
    odds = [0.5 if p is None else p for p in out]
    return odds, [parent >= 0 and odds[parent] > 0.5 for _, parent in page.elements]


def scores(page: Page, learned: Mapping[str, float]) -> list[float]:
    odds, within = outside_odds(page, learned)
    return [-n * log(odds[e]) if n else 0.0 if within[e] else log(1 - odds[e]) for n, e in page.tokens]


def region(values: Iterable[float]) -> tuple[int, int]:
    """Where the contiguous stretch of the highest sum begins and ends; the first and shortest of equals, (0, 0) if no score is above 0."""
    best = total = 0.0
    start, span = 0, (0, 0)
    for i, score in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, learned: Mapping[str, float]) -> str:
    """The blocks of the best region, in page order, joined by a line break. Empty without any words."""
    if not page:
        return ""
    p = Page(page)
    odds, _ = outside_odds(p, learned)
    low, high = region(scores(p, learned))
    blocks: list[list[str]] = []
    last = None
    for raw, e, at, block in p.stretches:
        if odds[e] > 0.5 or not low <= at < high:
            last = None
            continue
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(raw)
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = 1000, longest: int = 50_000) -> dict[str, float]:
    """What at most `most` pages of at most `longest` characters teach that hold an article element, chosen by a hash of the id.

    Ids are chosen first, so that only these pages' html goes to the driver; pages that share an id count once.
    """
    some = pages.select(F.col(id_col).alias("id"), whole(html_col).alias("h")).filter(F.length("h").between(1, longest) & F.col("h").contains("</article>"))
    ids = some.select("id", F.xxhash64("id", F.lit(7)).alias("r")).filter("id is not null").distinct().orderBy("r", "id").limit(most)
    return learnt([r.h for r in some.join(F.broadcast(ids.select("id")), "id").groupBy("id").agg(F.min("h").alias("h")).orderBy("id").select("h").collect()])


def extracted(pages: DataFrame, learned: Mapping[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page. Null and empty pages, and pages without words outside of furniture, have an empty text. Rows that
    repeat an id are pages of their own; other columns are not looked at; an empty table stays empty."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole(html_col).alias("html"))

    def run(batches):
        for b in slices(batches):
            texts = [main_text(h, learned) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())]))

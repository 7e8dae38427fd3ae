"""Main text of web pages by line-block distribution.

Markup is stripped to blocks, one line each, in page order. Scripts, styles, forms and elements that say
what they are (nav, footer, aside, or a class, id or role such as ad, cookie, comments, sidebar) leave at
once; a name that may be a subject as well (share, promotion, related, search) only tells where its element
holds mostly links or nothing like a sentence. A page that marks its article (article or main) gives all other
blocks within the mark, lists of links and short ones among them. On any other page a line's weight is its
length without its links, and the weights of `width` neighbouring lines are summed: where the sum surges over the
threshold there is a region, which reaches back to the first line after the last dive to nothing and on to
the next dive, and all lines between stay. So `width` or more lines of links in a row end a region. Where no
sum surges, the region with the highest one stays.

Markup is read in one pass, as browsers read it: an attribute's quoted value goes up to its quote, whatever and
however much it holds; a quote that never closes is a character like others.

Defined cases: null and empty pages, and pages without text, give the empty string; unclosed elements and
comments reach to the end of what holds them, an unclosed head ends with the first element that is none of
its own; tags without an end go up to the next tag; very long pages take time in proportion to their
length; of regions with equally high sums the first stays; a mark without text counts as none; repeated rows (and null
or repeated page_ids) are treated row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_PLAIN = re.compile(r"[^<>\"']*")
_DECLARED = re.compile(r"<[!?][^<>]*>?")
_TAIL = re.compile(r"[^<>]*>?")
_RAW = frozenset("script style noscript template svg iframe textarea select object canvas title".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow msub msup mfrac q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: An article inside one of these (a form around the page, a menu that is never closed) is an article.
_LOOSE = frozenset("nav header form menu".split())
_KEEP = frozenset(("article", "main"))
#: Tags that hold text themselves: a name that may be a subject (search, related) says nothing about them.
_TEXT = frozenset("p li td th dt dd blockquote pre figure figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class or id that tell boilerplate: of any element, and of elements that hold others only.
_ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted banner cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter breadcrumb breadcrumbs copyright disqus".split()
)
_HOLDERS = frozenset("comment comments sidebar menu nav navbar navigation footer header masthead toolbar signup login pagination pager widget widgets skiplink".split())
#: The same, where the element is mostly links or holds nothing like a sentence.
_MAYBE = frozenset("share sharing social promotion promotions alert subscribe subscription".split())
_MAYBE_HOLDERS = frozenset("reply replies side related recommend recommended recommendations search".split())
#: What tells of an article that it is another's comment or an advert.
_NO_ARTICLE = frozenset("comment comments ad ads advert advertisement sponsored promoted".split())
#: Parts that may stand beside those: with any other word ("related-work") a name is no boilerplate.
_BESIDE = frozenset(
    "area articles bar block body bottom box button buttons container content fixed form global group inner item items label left link links list main message page panel"
    " post posts primary right row secondary section site slot sticky text thread title top unit user wrap wrapper the".split()
)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSED_BY = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


def _named(value: str, telling: frozenset, beside: frozenset = _BESIDE) -> bool:
    """Whether a class or id is made of telling parts and what may stand beside them."""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if any(p in telling for p in parts) and all(p in telling or p in beside or p.isdigit() for p in parts):
            return True
    return False


def _boilerplate(tag: str, attrs: str, in_article: bool) -> int:
    """2: boilerplate; 1: so if its content agrees; 0: none."""
    if tag in _DROP and not (tag == "header" and in_article):  # an article's own header holds its title
        return 2
    if not attrs or attrs.isspace():
        return 0
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = [found.get(k, "") for k in ("class", "id")]
    if tag in ("main", "body", "html"):
        return 2 * (found.get("role", "").lower() in _ROLES)
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in _ROLES:
        return 2
    if tag == "article":
        return 2 * any(_named(x, _NO_ARTICLE) for x in names)
    if tag in _HEADINGS:
        return 0
    sure, maybe = (_ALWAYS, _MAYBE) if tag in _TEXT else (_ALWAYS | _HOLDERS, _MAYBE | _MAYBE_HOLDERS)
    if in_article:
        sure -= {"header"}
    if any(_named(x, sure, _BESIDE | maybe) for x in names):
        return 2
    return int(any(_named(x, maybe) for x in names))


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag or "", whether it ends an element, attributes) from start to end, in one pass.

    A tag "" stands for a comment, a declaration, an element of raw text with its content, or the page's end.
    """
    at, size, quotes = 0, len(page), {}
    text: list[str] = []

    def closing(quote: str, start: int) -> int:
        known = quotes.get(quote, 0)
        if 0 <= known < start:
            known = quotes[quote] = page.find(quote, start)  # -1: none is left, which holds from there on
        return known

    while at < size:
        low = page.find("<", at)
        if low < 0:
            break
        text.append(page[at:low])
        at = low
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            at = size if end < 0 else end + 3
        elif m := _DECLARED.match(page, at):
            at = m.end()
        elif m := _NAME.match(page, at):
            tag, start = m[2].lower(), m.end()
            at = start
            while True:
                at = _PLAIN.match(page, at).end()
                if at >= size or page[at] in "<>":
                    break
                k = at - 1
                while page[k].isspace():
                    k -= 1
                end = closing(page[at], at + 1) if page[k] == "=" else -1
                at = end + 1 if end >= 0 else at + 1
            attrs = page[start:at]
            at += at < size and page[at] == ">"
            if tag in _RAW and not m[1] and not (tag == "svg" and attrs.endswith("/")):
                end = _RAW_END[tag].search(page, at)
                at = size if end is None else _TAIL.match(page, end.end()).end()
                yield "".join(text), "", False, "raw"
            else:
                yield "".join(text), tag, bool(m[1]), attrs
            text = []
            continue
        else:
            text.append("<")
            at += 1
            continue
        yield "".join(text), "", False, ""
        text = []
    yield "".join(text) + page[at:], "", False, ""


def _sentence(text: str) -> bool:
    return len(text) >= 40 or text.rstrip("\"')»”’")[-1:] in tuple(".!?…:;。")


def blocks(page: str) -> list[tuple[str, bool, int]]:
    """(text, within article or main, characters inside links) of every block that is not boilerplate."""
    out: list[tuple[str, bool, int, int]] = []
    stack: list[tuple[str, int, bool, int]] = []  # of open elements that are not inline: tag, dropped (1: unless an article begins), kept, doubtful
    doubts = [-1]  # of each doubtful element the one around it; number 0 stands for none
    runs: list[str] = []
    linked = links = 0

    def top() -> tuple[str, int, bool, int]:
        return stack[-1] if stack else ("", 0, False, 0)

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                out.append((text, top()[2], linked, top()[3]))
            runs.clear()
        linked = 0

    def push(tag: str, dropped: int, kept: bool, sort: int) -> None:
        if sort == 1:
            doubts.append(top()[3])
        stack.append((tag, dropped, kept, len(doubts) - 1 if sort == 1 else top()[3]))

    for raw, tag, end, attrs in tokens(page):
        if raw and not top()[1]:
            text = html.unescape(raw)
            runs.append(text)
            if links:
                linked += len(text.strip())
        if not tag:
            if attrs:
                runs.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if end else 1
            elif tag == "br":
                runs.append(" ")
            if not end and tag == "span" and (sort := _boilerplate(tag, attrs, top()[2])) == 2:
                flush()
                push(tag, 2, top()[2], sort)
            elif end and stack and stack[-1][0] == tag:
                stack.pop()
            continue
        flush()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in _VOID and not attrs.endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            elif tag in _CLOSED_BY:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in _CLOSED_BY[tag]:
                        break
            elif tag not in ("p",) and stack and stack[-1][0] == "p":
                stack.pop()
            _, dropped, kept, _ = top()
            sort = _boilerplate(tag, attrs, kept)
            if sort == 2:
                dropped = max(dropped, 1 if tag in _LOOSE else 2)
            elif tag in _KEEP and dropped == 1:
                dropped = 0
            push(tag, dropped, kept or tag in _KEEP, sort)
    flush()

    size, inside, said = ([0] * len(doubts) for _ in range(3))
    for text, _, n, k in out:
        size[k], inside[k], said[k] = size[k] + len(text), inside[k] + n, said[k] + _sentence(text)
    for k in range(len(doubts) - 1, 0, -1):
        up = doubts[k]
        size[up], inside[up], said[up] = size[up] + size[k], inside[up] + inside[k], said[up] + said[k]
    gone = [False] * len(doubts)
    for k in range(1, len(doubts)):
        gone[k] = gone[doubts[k]] or 2 * inside[k] > size[k] or not said[k]
    return [(text, kept, n) for text, kept, n, k in out if not gone[k]]


def regions(weights: list[int], width: int, threshold: int, back: bool = False) -> list[tuple[int, int]]:
    """[surge, dive) ranges of lines: the window sum rises over threshold, later falls to nothing.

    back: a region begins at the first line with weight after the last dive. Without any surge, the lines
    between two dives around the highest sum are the region.
    """
    n, sums = len(weights), [0]
    for x in weights:
        sums.append(sums[-1] + x)
    window = [sums[min(n, i + width)] - sums[i] for i in range(n)]
    found, best, i = [], (0, 0, 0), 0
    while i < n:
        if not window[i] or not weights[i]:
            i += 1
            continue
        end = i
        while end < n and window[end]:
            end += 1
        surge = next((j for j in range(i, end) if window[j] > threshold and weights[j]), None)
        if surge is not None:
            found.append((i if back else surge, end))
        else:
            best = max(best, (max(window[i:end]), -i, end))
        i = end
    return found or ([(-best[1], best[2])] if best[0] else [])


def extract(page: str | None, width: int = 3, threshold: int = 86) -> str:
    rows = blocks(page or "")
    marked = [t for t, kept, _ in rows if kept]
    if marked:
        return "\n\n".join(marked)
    weights = [len(t) - min(linked, len(t)) for t, _, linked in rows]
    if not any(weights):  # nothing but links
        weights = [len(t) for t, _, _ in rows]
    spans = regions(weights, width, threshold, back=True)
    return "\n\n".join(t for a, b in spans for t, _, _ in rows[a:b])


def extract_pages(pages: DataFrame, width: int = 3, threshold: int = 86) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), width, threshold) for h in b.column("html")]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), sizes], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

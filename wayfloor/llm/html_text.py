"""Main text of web pages by line-block distribution (operator 11).

Markup is stripped into lines, one a block element; inline elements and ``<br>``
stay inside their line.  A line weighs the characters of its text.  What markup
names as something else weighs nothing: menus, headers and footers of the page,
sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader
comments, by element, role, class or id; so does what lies outside of the
article where the page marks one.  Elsewhere linked text weighs against its line.
The weights are summed over sliding windows of lines; text begins where the sums
surge over a threshold and ends where they dive to nothing, and what lies
between is kept.

All is linear in the length of a page, and pages are independent rows: nothing
is shuffled.

Defined cases: null or empty html has no text; broken markup is read as far as
it goes (an unclosed comment or script runs to the end, an end tag without a
start is ignored); a page without text outside of links and named parts has none.  ``<br>`` and table cells
count as white space inside their block, no-break spaces as white space.  A
class or form mark around the article itself, or around most of a page that
marks none, is ignored.  Repeated rows give repeated results, null ids and urls
stay, extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import small

#: Lines of a window; least sum of a surge on pages that mark no article; share of the largest stretch that another needs there.
WINDOW, SURGE, SHARE = 3, 86, 0.34

# The names that markup has for its parts.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select noframes".split())
NEVER = frozenset("nav footer aside head button dialog menu noscript datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar tablist".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription paywall sidebar side nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended recommendations widget widgets pagination pager login signin signup register search skip disclaimer copyright taboola outbrain".split()
)
DISTINCT = ("advert", "sponsor", "cookie", "sidebar", "comment", "newsletter", "breadcrumb", "adsby", "navbar", "footer", "paywall", "disqus")
#: Words that turn a mark of a class around (``has-sidebar``, ``article-header``).
TURNED = frozenset("has with no without article post entry story content main body headline title".split())
CONTENT = frozenset("content main article post entry story articlebody maincontent".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]*+))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _tags(text: str):
    """(begin, end, name, is an end tag, attributes as text) of the tags in order; comments and the like have no name."""
    at, n, unclosed = 0, len(text), set()
    while True:
        a = text.find("<", at)
        if a < 0:
            return
        after = text[a + 1 : a + 2]
        if after == "!" or after == "?":
            if text.startswith("<!--", a):
                end = text.find("-->", a + 4)
                end = n if end < 0 else end + 3
            else:
                end = text.find(">", a)
                end = n if end < 0 else end + 1
            yield a, end, "", False, ""
            at = end
            continue
        closing = after == "/"
        name = _NAME.match(text, a + 1 + closing)
        if not name:
            if closing:  # a bogus comment
                end = text.find(">", a)
                end = n if end < 0 else end + 1
                yield a, end, "", False, ""
                at = end
            else:
                at = a + 1
            continue
        end = name.end()
        while True:
            stop = _STOP.search(text, end)
            if not stop:
                end = inner = n
                break
            if stop[0] == ">":
                inner, end = stop.start(), stop.end()
                break
            end = stop.end()
            if stop[0] not in unclosed and text[max(name.end(), stop.start() - 3) : stop.start()].rstrip().endswith("="):
                quote = text.find(stop[0], end)
                if quote < 0:
                    unclosed.add(stop[0])  # none follows, here or later
                else:
                    end = quote + 1
        low = name[0].lower()
        yield a, end, low, closing, text[name.end() : inner]
        at = end
        if low in RAW and not closing:
            close = re.compile(f"</{low}(?=[\\s/>])", re.I).search(text, end)
            at = close.start() if close else n
            yield end, at, "", False, ""


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _named_apart(attributes: dict[str, str]) -> bool:
    """Whether class, id or the like name something other than the article."""
    for key in ("class", "id"):
        for token in attributes.get(key, "").split():
            words = [w.lower() for w in _WORD.findall(token)]
            if any(w in TURNED for w in words) and not any(w.startswith(("comment", "related", "sidebar", "advert")) and words[0] not in ("has", "with", "no", "without") for w in words):
                continue
            if any(w in MARKS for w in words) or any(d in token.lower() for d in DISTINCT):
                return True
    return False


class _Page:
    """Chunks of text with the line they belong to, and stretches of chunks that markup names."""

    def __init__(self, text: str):
        self.chunks: list[str] = []
        self.line: list[int] = []
        self.linked: list[bool] = []
        self.heading: list[int] = []
        self.strong: list[tuple[int, int]] = []  # never the article
        self.weak: list[tuple[int, int]] = []  # not the article, unless they hold it
        self.headers: list[tuple[int, int]] = []
        self.articles: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []
        self.contents: list[tuple[int, int]] = []
        self._read(text)

    def _read(self, text: str):
        line, at, links, heading = 0, 0, 0, 0
        stack: list[tuple] = []  # (name, first chunk, kinds)
        open_: Counter = Counter()

        def add(a: int, b: int):
            if b > a:
                self.chunks.append(entities.unescape(text[a:b]))
                self.line.append(line)
                self.linked.append(links > 0)
                self.heading.append(heading)

        def pop():
            nonlocal links
            name, first, kinds = stack.pop()
            open_[name] -= 1
            links -= name == "a"
            for kind in kinds:
                getattr(self, kind).append((first, len(self.chunks)))

        for begin, end, name, closing, inner in _tags(text):
            add(at, begin)
            at = end
            if not name:
                continue
            block = name in BLOCKS
            if block:
                line += 1
            elif name in ("br", "td", "th"):
                self.chunks.append(" ")
                self.line.append(line)
                self.linked.append(False)
                self.heading.append(heading)
            if closing:
                if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    heading = 0
                if open_[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = int(name[1])
            elif block:
                heading = 0
            if name in VOID:
                continue
            if name in ("p", "li", "a", "option", "tr") and open_[name] and stack[-1][0] == name:
                pop()
            stack.append((name, len(self.chunks), self._kinds(name, _attributes(inner))))
            open_[name] += 1
            links += name == "a"
        add(at, len(text))
        while stack:
            pop()

    @staticmethod
    def _kinds(name: str, attributes: dict[str, str]) -> tuple[str, ...]:
        role = attributes.get("role", "").lower()
        if name in NEVER or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return ("strong",)
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
            return ("strong",)
        if name in ("html", "body"):
            return ()
        if name == "header":
            return ("headers",)
        if name == "form" or _named_apart(attributes):
            return ("weak",)
        if name == "article" or "articleBody" in attributes.get("itemprop", "") or role == "article":
            return ("articles",)
        if name == "main" or role == "main":
            return ("mains",)
        words = {"".join(w.lower() for w in _WORD.findall(t)) for key in ("class", "id") for t in attributes.get(key, "").split()}
        words |= {w.lower() for key in ("class", "id") for w in _WORD.findall(attributes.get(key, ""))}
        return ("contents",) if name in ("div", "section", "td") and words & CONTENT else ()


def _cover(n: int, stretches) -> list[bool]:
    """Which of n chunks lie in any of the stretches."""
    change = [0] * (n + 1)
    for a, b in stretches:
        change[a] += 1
        change[b] -= 1
    return [c > 0 for c in accumulate(change[:n])]


def _holds(outer: tuple[int, int], inner: tuple[int, int]) -> bool:
    return outer[0] <= inner[0] and inner[1] <= outer[1]


def article_of(page: _Page) -> tuple[list[bool], list[bool] | None]:
    """(chunks that are named as something else, chunks of the marked article or None)."""
    n = len(page.chunks)
    size = [0, *accumulate(len(c.split()) and len(c) for c in page.chunks)]
    length = lambda s: size[s[1]] - size[s[0]]
    strong = _cover(n, page.strong)
    inside = lambda s, marks: s[0] < n and marks[s[0]] and s[1] > s[0]
    weak = _cover(n, page.weak)
    zones: list[tuple[int, int]] = []
    for kind in (page.articles, page.mains):
        there = [s for s in kind if length(s) and not inside(s, strong)]
        zones = [s for s in there if not inside(s, weak)] or there
        if zones:
            break
    if not zones:
        # A content element counts where it holds most of what is not named otherwise.
        other = [a or b for a, b in zip(strong, weak)]
        total = sum(len(c) for c, o in zip(page.chunks, other) if not o)
        there = [s for s in page.contents if not inside(s, other) and 2 * length(s) > total]
        zones = [min(there, key=length)] if there else []
    if zones:
        largest = max(zones, key=length)
        apart = [s for s in page.weak if not _holds(s, largest)]
    else:
        apart = [s for s in page.weak if 2 * length(s) <= size[-1]]
    marked = _cover(n, zones) if zones else None
    # A header belongs to the article if it holds its headline.
    headings = [i for i, h in enumerate(page.heading) if h and not strong[i]] if zones else [i for i, h in enumerate(page.heading) if h == 1][:1]
    starts = sorted(a for a, _ in zones) or [0]

    def of_article(s):
        zone = bisect_right(starts, s[0]) - 1
        first = bisect_left(headings, starts[zone]) if zone >= 0 else len(headings)
        return first < len(headings) and s[0] <= headings[first] < s[1] and not (marked and not inside(s, marked))

    headers = [s for s in page.headers if not of_article(s)]
    return [a or b for a, b in zip(strong, _cover(n, apart + headers))], marked


def kept_lines(weights: list[int], surge: int, share: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of lines between the surge and dive points of the windows' sums that have ``share`` of the largest weight.

    Where no window comes up to ``surge``, the highest one is the surge.
    """
    n = len(weights)
    upto = [0, *accumulate(weights)]
    sums = [upto[min(n, i + window)] - upto[i] for i in range(n)]
    surge = max(1, min(surge, max(sums, default=0)))
    found, i = [], 0
    while i < n:
        if sums[i] >= surge and weights[i]:
            j = i
            while j < n and sums[j]:
                j += 1
            found.append((i, j))
            i = j
        else:
            i += 1
    most = max((upto[b] - upto[a] for a, b in found), default=0)
    return [(a, b) for a, b in found if upto[b] - upto[a] >= share * most]


def main_text(text: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    """The main text of a page: its blocks, one a line."""
    if not text:
        return ""
    page = _Page(text)
    other, marked = article_of(page)
    lines: list[list] = []  # [text chunks, linked characters, heading]
    last = None
    for chunk, line, linked, heading, apart, inside in zip(page.chunks, page.line, page.linked, page.heading, other, marked or other):
        if line != last:
            lines.append([[], 0, 0, False])
            last = line
        here = lines[-1]
        if apart or (marked and not inside):
            here[3] = True  # stands as an empty line
            continue
        here[0].append(chunk)
        here[1] += len(chunk.strip()) if linked else 0
        here[2] = here[2] or heading
    blocks = [(" ".join("".join(parts).split()), links, heading, apart) for parts, links, heading, apart in lines]
    blocks = [b for b in blocks if b[0] or b[3]]
    if marked:
        # Whatever markup names apart leaves a gap, which must not end the article.
        blocks = [b for b in blocks if b[0]]
        spans = kept_lines([len(b[0]) for b in blocks], 1, 0.0, window)
    else:
        spans = kept_lines([max(0, len(b[0]) - 2 * b[1]) for b in blocks], surge, share, window)
        firsts = [i for i, b in enumerate(blocks) if b[2] == 1 and b[0]]
        if len(firsts) == 1:  # the headline begins the text
            spans = [(max(a, firsts[0]) if a < firsts[0] < b else a, b) for a, b in spans]
    return "\n".join(b[0] for a, z in spans for b in blocks[a:z] if b[0])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """``(id, url, text, n_chars)`` of every page; ``n_chars`` counts code points."""
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in small(batches, 256):
            texts = [main_text(t, **options) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"]
            )

    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")

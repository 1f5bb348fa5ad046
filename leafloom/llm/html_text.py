"""Main text of web pages by minimum cut (operator 7).

A page becomes a list of blocks (runs of text between block-level tags) with
the path of elements above each. A linear classifier over a block's features
(what elements and class names stand above it, share of text in links, length,
commas and stops, whether it looks like a notice) gives the cost of calling it content and
of calling it boilerplate. These costs are the terminal capacities of a graph;
neighbours in page order, and blocks that share a deep container, are joined by
smoothness edges. The minimum cut (Dinic's maximum flow) is the labelling of
least total cost. Elements whose meaning is fixed (nav, footer, form and the
like, by tag or role, and what is hidden) have capacities that no smoothness
outweighs. Class names and ids (comments, sidebar) only add a cost: what they
mark may be a wrapper of the page. main, and an article that alone holds an h1
or has more than half of the page's text, clear the mark of the elements around
them; a marked element with an h1 and more text than is outside of marks, or
with all text, keeps a small cost.

Defined results
  null html        the empty page: no text
  unclosed tags    closed where HTML closes them: p, li, td, ... by their next sibling, others with their parent;
                   svg, object, select, noscript without end tag are ignored as tags
  broken tags      a quote starts a value only after =; one that is not closed is a character like others; a tag
                   without > is text
  very long pages  whole, in time that grows with the page; proximity edges per block are bounded, so the graph does, too
  null page_id     a page like any other
  repeated rows    one result row each
  empty table      no rows
  other columns    ignored
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafloom.session import bound_batches

# Element names by what they do here.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul video audio canvas iframe".split())
RAW = frozenset("script style template textarea title iframe noembed noframes xmp".split())
#: Elements with markup inside that are skipped from start tag to end tag; a start tag without an end tag is ignored.
SKIPPED = frozenset("svg object select noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "video", "audio", "canvas", "iframe", "td", "th", "tr", "tbody", "thead", "tfoot"}
NEVER = frozenset("nav footer aside form menu dialog button search option optgroup".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words in class names and ids that tell what an element is for.
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion related recommended replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget".split())
GOOD_WORDS = frozenset("article content entry main post story text body".split())
# Words before a bad one that make a name tell of a state or subject (has-sidebar, no-comments, tag-cookies) ...
STATE_WORDS = frozenset("has no not with without hide show category tag type format status".split())
# ... of layout, next to a good word (content-sidebar-wrap), and of what a header is the title of (entry-header).
WRAP_WORDS = frozenset("wrap wrapper container layout outer inner grid row columns".split())
TITLED_WORDS = frozenset("article content entry post story".split())
NOTICE = re.compile(r"©|\b(?:all rights reserved|cookies?|privacy policy|terms of (?:use|service)|subscribe|sign up|log ?in|newsletter|advertisement|sponsored)\b", re.I)

# Possessive throughout: a tag is read once. A page in which many tags end only inside quotes is read without quotes from there on.
_OTHER = r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"
_TOKEN = re.compile(_OTHER + r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>", re.S)
_LOOSE = re.compile(_OTHER + r"([^>]*+)>", re.S)
LOOSE_TAGS = 20
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_BARE_SLASH = re.compile(r"=\s*[^\s\"'=]*/\Z")
_SKIPPED = re.compile(f"<(?:{'|'.join(sorted(SKIPPED))})", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACE = re.compile(r"\s+")

#: A capacity above anything the other edges add up to at a block.
CERTAIN = 1000.0
ADJACENT, NEAR = 0.6, 0.9
#: Costs of calling content what a class name marks; of a mark on what looks like the page's wrapper.
MARKED, MARKED_WRAPPER = 8.0, 1.0
#: Blocks of one container that are tied to the container's previous blocks, each.
TIES = 2


#: What main and article say about being a content container; class words say 1.
MAIN, ARTICLE = 2.5, 2.0


class _Element:
    """Of an open element: what it and those above it are, so that no question needs a walk up."""

    __slots__ = ("bad", "good", "name", "number", "parent", "link", "mark", "article", "inside", "block", "p")

    def __init__(self, name: str, number: int, parent: _Element | None, bad: bool, good: float, marked: bool = False) -> None:
        self.name, self.number, self.parent = name, number, parent
        self.bad = bad or bool(parent and parent.bad)
        marked = marked and not (name == "article" and not (parent and parent.mark))
        #: The nearest element that class words mark; the article between it and here.
        self.mark = self if marked else parent.mark if parent and good < MAIN else None
        self.article = None if marked or not parent else self if good == ARTICLE else parent.article
        self.good = 0.0 if marked else max(good, parent.good if parent else 0.0)
        self.link = name == "a" or bool(parent and parent.link)
        self.inside = name in ("article", "main") or bool(parent and parent.inside)
        #: The nearest block-level element, and the p that no block-level element stands in.
        self.block = self if name in BLOCK or not parent else parent.block
        self.p = self if name == "p" else None if name in BLOCK or not parent else parent.p


class Block:
    __slots__ = ("text", "owner", "linked", "heading")

    def __init__(self, text: str, owner: _Element, linked: int, heading: bool) -> None:
        self.text, self.owner, self.linked, self.heading = text, owner, linked, heading


def _name_says(name: str, inside_article: bool) -> int:
    """-1, 0 or 1: a class name or id tells of boilerplate, nothing or content."""
    words = [w.lower() for w in _WORDS.findall(_CAMEL.sub(r"\1 \2", name))]
    bad = [k for k, w in enumerate(words) if w in BAD_WORDS]
    good = [k for k, w in enumerate(words) if w in GOOD_WORDS]
    if not bad:
        return 1 if good else 0
    before = words[: bad[0]]
    if not STATE_WORDS.isdisjoint(before) or good and not WRAP_WORDS.isdisjoint(words):
        return 0
    if {words[k] for k in bad} == {"header"} and (inside_article or not TITLED_WORDS.isdisjoint(before)):
        return 0
    return -1


def _nature(name: str, attrs: str, inside_article: bool) -> tuple[bool, float, bool]:
    """(surely boilerplate, how much it looks like a content container, marked by class words)"""
    good = MAIN if name == "main" else ARTICLE if name == "article" else 0.0
    bad = name in NEVER or (name == "header" and not inside_article)
    marked = False
    if attrs:
        for m in _ATTR.finditer(attrs) if _TELLING.search(attrs) else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                bad |= value.lower() in BAD_ROLES
                good = max(good, {"main": MAIN, "article": ARTICLE}.get(value.lower(), 0.0))
            elif key in ("class", "id"):
                says = {_name_says(x, inside_article) for x in value.split()}
                if -1 in says:
                    marked = True
                elif 1 in says:
                    good = max(good, 1.0)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                bad = True
    if name in ("body", "html") or good == MAIN:
        marked = False
    return bad, good, marked


class _Tags:
    """The page's tags and comments, one after the other."""

    def __init__(self, page: str) -> None:
        self.page, self.limit, self.loose = page, page.rfind(">") + 1, 0

    def next(self, at: int) -> re.Match | None:
        if self.loose > LOOSE_TAGS:
            return _LOOSE.search(self.page, at, self.limit)
        start = self.page.find("<", at, self.limit)
        while start >= 0:
            if m := _TOKEN.match(self.page, start, self.limit):
                return m
            if m := _LOOSE.match(self.page, start, self.limit):
                self.loose += 1
                return m
            start = self.page.find("<", start + 1, self.limit)
        # A comment that is not closed may start after the last >.
        start = self.page.find("<!--", max(at, self.limit))
        return _TOKEN.match(self.page, start) if start >= 0 else None

    def raw_end(self, name: str, at: int) -> int:
        stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(self.page, at, self.limit)
        return stop.end() if stop else len(self.page)


def _skips(page: str) -> dict[int, int]:
    """Where SKIPPED elements start, and where each one ends; a start tag without an end tag ends at once."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in SKIPPED}
    if not _SKIPPED.search(page):
        return found
    at, tags = 0, _Tags(page)
    while m := tags.next(at):
        at, name = m.end(), (m[2] or "").lower()
        if name in SKIPPED:
            if m[1]:
                if opened[name]:
                    found[opened[name].pop()] = at
            else:
                found[m.start()] = at
                if not (name == "svg" and m[3].endswith("/")):
                    opened[name].append(m.start())
        elif name in RAW and not m[1] and not (opened["svg"] and m[3].endswith("/")):
            at = tags.raw_end(name, at)
    return found


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; inline tags stay inside a block, block-level ones and line breaks of two end it."""
    root = _Element("#", 0, None, False, 0.0)
    top, made, number = root, [], 0
    parts: list[str] = []
    opened: Counter[str] = Counter("#")
    linked = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                owner = top.block
                made.append(Block(text, owner, min(linked, len(text)), owner.name in ("h1", "h2", "h3", "h4", "h5", "h6")))
            parts.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if top.link:
                linked += len(s)

    def close(until: _Element) -> None:
        nonlocal top
        while top is not until:
            if top.name in BLOCK:
                end()
            opened[top.name] -= 1
            top = top.parent

    skips, tags = _skips(page), _Tags(page)
    at, size = 0, len(page)
    while at < size:
        m = tags.next(at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in SKIPPED:
            at = skips.get(m.start(), at)
            continue
        if m[1]:
            if name in BLOCK:
                end()
            if opened[name]:
                found = top
                while found.name != name:
                    found = found.parent
                close(found.parent)
            continue
        if name in RAW:
            at = tags.raw_end(name, at)
            if name in BLOCK:
                end()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in CLOSES_P and top.p:
            close(top.p.parent)
        while name in BLOCK and name not in ("option", "optgroup", "hr") and top.name in ("option", "optgroup"):
            close(top.parent)
        if name in CLOSED_BY_SELF and opened[name]:
            same = top
            while same and same.name not in CLOSED_BY_SELF[name] and same.name != name:
                same = same.parent
            if same and same.name == name:
                close(same.parent)
        if name in BLOCK:
            end()
        if name in VOID or m[3].endswith("/") and name not in BLOCK and not _BARE_SLASH.search(m[3]):
            continue
        number += 1
        opened[name] += 1
        top = _Element(name, number, top, *_nature(name, m[3], top.inside))
    close(root)
    end()
    return made


def marks(found: list[Block]) -> list[float]:
    """For each block, the cost that class words put on calling it content."""
    out = [0.0] * len(found)
    if all(b.owner.mark is None for b in found):
        return out
    size: Counter[int] = Counter()
    titled = set()
    seen: dict[int, _Element] = {}
    total = plain = 0  # of all text, of what no class word marks
    for b in found:
        if b.owner.bad:
            continue
        n = len(b.text) - b.linked
        total += n
        plain += n if b.owner.mark is None else 0
        for e in (b.owner.mark, b.owner.article):
            if e:
                size[e.number] += n
                if b.owner.name == "h1":
                    titled.add(e.number)
        mark = b.owner.mark
        while mark and mark.number not in seen:
            seen[mark.number] = mark
            mark = mark.parent.mark
    for k in sorted(seen, reverse=True):  # what a marked element holds, the marked one above it holds, too
        up = seen[k].parent.mark
        if up:
            size[up.number] += size[k]
            if k in titled:
                titled.add(up.number)
    articles = {b.owner.article.number for b in found if b.owner.article and not b.owner.bad}
    clear = {k for k in articles if 2 * size[k] > total} or (titled & articles if len(titled & articles) == 1 else set())
    for i, b in enumerate(found):
        mark, article = b.owner.mark, b.owner.article
        if mark and not (article and article.number in clear):
            held = size.get(mark.number, 0)
            wrapper = held > plain and (mark.number in titled or held == total)
            out[i] = MARKED_WRAPPER if wrapper else MARKED
    return out


def costs(block: Block, mark: float = 0.0) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content), by a linear classifier.

    The weights are fixed values of this operator.
    """
    if block.owner.bad:
        return 0.0, CERTAIN
    words = block.text.count(" ") + 1
    density = block.linked / len(block.text)
    good = 0.0 if mark == MARKED else min(block.owner.good, 2.0)
    score = 0.4 + 1.5 * good - mark - 4.0 * density + 0.06 * min(words, 40) + 0.15 * min(sum(map(block.text.count, ".,;:!?")), 6)
    score += 0.8 * block.heading + 0.5 * (block.owner.name == "p") - 1.0 * (block.owner.name == "li" and density > 0.5)
    if words < 25 and NOTICE.search(block.text) and block.owner.good < 2.0:
        score -= 3.0
    return max(score, 0.0), max(-score, 0.0)


def cut(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether the minimum cut leaves it on the source's side.

    keep[i]: capacity from the source; drop[i]: capacity to the sink.
    """
    n = len(keep)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(there)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(keep[i], drop[i])
        if keep[i] > both:
            join(s, i, keep[i] - both, 0.0)
        elif drop[i] > both:
            join(i, t, drop[i] - both, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in head[x]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                x = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[x] < len(head[x]):
                e = head[x][at[x]]
                if cap[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                at[x] += 1
            if at[x] < len(head[x]):
                path.append(head[x][at[x]])
                x = to[head[x][at[x]]]
            elif path:
                x = to[path.pop() ^ 1]
                at[x] += 1
            else:
                break


def _edges(found: list[Block], marked: list[float]) -> list[tuple[int, int, float]]:
    edges = []
    last: dict[int, list[int]] = {}
    alone = [b.owner.bad or m == MARKED for b, m in zip(found, marked, strict=True)]
    for i, b in enumerate(found):
        if i and not (alone[i] or alone[i - 1]):
            edges.append((i - 1, i, ADJACENT if b.owner.parent is found[i - 1].owner.parent else ADJACENT / 3))
        up = b.owner.parent
        if up is not None and not alone[i] and up.name not in ("body", "html", "#"):
            before = last.setdefault(up.number, [])
            edges.extend((j, i, NEAR / (1 + k)) for k, j in enumerate(reversed(before)) if j != i - 1 or k)
            before.append(i)
            del before[:-TIES]
    return edges


def extract(page: str | None) -> str:
    """The page's main text: its content blocks, one per line."""
    found = blocks(page or "")
    if not found:
        return ""
    marked = marks(found)
    pairs = [costs(b, m) for b, m in zip(found, marked, strict=True)]
    stays = cut([k for k, _ in pairs], [d for _, d in pairs], _edges(found, marked))
    return "\n".join(b.text for b, ok in zip(found, stays, strict=True) if ok)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column("html")]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    read = pages.select(pages["page_id"].cast("bigint").alias("page_id"), "url", "html")
    return read.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

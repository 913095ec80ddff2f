"""HTML extraction by consensus host paths.

A pass over a page's tags finds its blocks of text and its containers, each with its generalised path (tags and classes
from the root, numbers replaced; kept as a hash) and the blocks in it. Each page votes for the path of its innermost
container outside of which there is no text but that of links; Spark counts the votes of each host, and each page is
extracted again with the path that won on its host. A page without such a container falls back on its own best one.

Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by
tag, role, id or class, where a name or its last part counts and names like has-sidebar or no-ads don't. A header inside
an article or main element is the article's own and is kept. A container or form that holds most of the page's text
outside links isn't left out for its id, its class or being a form, unless an article or main element with text is kept.

Block-level tags end a block; inline tags, comments, scripts, styles and whatever is left out inside a block don't. Runs
of white space in a block become one space, blocks are trimmed and joined by line ends. A start tag of a block ends an
open paragraph; a link ends with the element it was opened in, or at the next link.

Defined results: null and empty html give an empty text, as do pages without text outside boilerplate. A page that
breaks off is read as far as it goes. Null and malformed URLs share one nameless host. Repeated rows give repeated
results; at equal votes the larger score, then the hash that sorts last, wins. Further columns are ignored. Time and
memory grow with a page's length, however deep its tags are nested.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.url_filters import host_of

MARKUP = re.compile(r"<!--|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+>|[^>]*(?:>|\Z))")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"article", "body", "div", "main", "section", "td", "html"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "label", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "replies", "reply", "share", "sharing", "sidebar", "sidebars", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
ABOUT = {"has", "no", "with", "without"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which a start tag closes nothing.
SCOPES = {tag: CONTAINERS - {"td"} | {"ul", "ol", "table", "dl", "select"} | ({"td", "th"} if tag in {"li", "dt", "dd", "option"} else set()) for tag in CLOSES}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: Elements that may hold a whole page, and so aren't left out for their id or class if they do.
SPARED = CONTAINERS | {"form"}


@dataclass(frozen=True)
class Container:
    """A container that isn't left out: its path's hash, its node, its blocks (a range), and what its score is made of."""

    path: str
    node: int
    first: int
    last: int
    letters: int
    linked: int
    plain: int

    @property
    def score(self) -> float:
        """Letters outside links, less those in links; a small share for each block tells articles from teasers."""
        return self.letters - 2 * self.linked + 5 * (self.last - self.first)


@dataclass(frozen=True)
class Page:
    """What is kept of a page: its blocks in order, its containers (outer ones first), and the parent and label of each node."""

    blocks: list[str]
    containers: list[Container]
    parents: list[int]
    labels: list[str]

    def path_of(self, container: Container) -> str:
        """The generalised path in full."""
        out, node = [], container.node
        while node > 0:
            if self.labels[node]:
                out.append(self.labels[node])
            node = self.parents[node]
        return "".join(reversed(out))


def _speaks(name: str) -> bool:
    """Whether a class or id, or its last part, names boilerplate; has-sidebar and the like tell of the page instead."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return bool(parts) and parts[-1] in NAMES and ABOUT.isdisjoint(parts)


def _names(attributes: str) -> tuple[list[str], bool, bool]:
    """Classes, whether role speaks of boilerplate, and whether class or id does."""
    classes, role, named = [], False, False
    for m in ATTRIBUTE.finditer(attributes):
        values = (m[2] or m[3] or m[4] or "").lower().split()
        kind = m[1].lower()
        if kind == "class":
            classes = values
        role |= kind == "role" and not ROLES.isdisjoint(values)
        named |= kind != "role" and any(map(_speaks, values))
    return classes, role, named


def plain_letters(text: list[tuple[str, bool]]) -> int:
    """Letters of a block outside links, without white space; marks between links don't count."""
    out = "".join(unescape("".join(t for t, in_link in text if not in_link)).split())
    return sum(map(str.isalnum, out)) if any(in_link for _, in_link in text) else len(out)


class _Tree:
    """The elements of a page that matter (nodes), and its blocks: runs of text, each with its node and whether it is in a link."""

    def __init__(self):
        self.tags, self.parents, self.labels, self.paths = [""], [-1], [""], [""]
        self.by_kind, self.by_name, self.spans = [False], [False], [[0, 0]]  # what is left out, and each node's blocks
        self.blocks: list[list[tuple[int, str, bool]]] = []
        self.text: list[tuple[int, str, bool]] = []
        self.stack = [0]
        self.open: dict[str, list[int]] = defaultdict(list)  # tag -> places in the stack
        self.link = 0  # the stack's size when the open link began, 0 without one

    def flush(self) -> None:
        if self.text:
            self.blocks.append(self.text)
            self.text = []

    def push(self, tag: str, attributes: str) -> None:
        classes, role, named = _names(attributes) if len(attributes) > 3 else ([], False, False)
        node, top = len(self.tags), self.stack[-1]
        page = tag in {"html", "body"}
        own_header = tag == "header" and (self.open["article"] or self.open["main"])
        self.by_kind.append(tag in BOILERPLATE and tag != "form" and not own_header or role and not page)
        self.by_name.append((named or tag == "form") and not page)
        self.tags.append(tag)
        self.parents.append(top)
        label = "/" + ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in classes)]) if tag in CONTAINERS else ""
        self.labels.append(label)
        self.paths.append(xxhash.xxh3_64_hexdigest(self.paths[top] + label) if label else self.paths[top])
        self.spans.append([len(self.blocks), -1])
        self.open[tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, size: int) -> None:
        """Close elements until the stack has ``size`` ones."""
        while len(self.stack) > size:
            node = self.stack.pop()
            self.open[self.tags[node]].pop()
            self.spans[node][1] = len(self.blocks)
        if self.link > size:
            self.link = 0

    def last(self, tags: set[str]) -> int:
        """The last place in the stack of one of ``tags``, 0 if none is open."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag not in VOID:
                self.cut(min([len(self.stack), *self.open["p"][-1:], *self.open["head"][-1:]]))
        if tag == "a":
            self.link = len(self.stack)
        if tag in VOID or tag not in BLOCKS and (tag not in BOILERPLATE or attributes.endswith("/>")):
            return
        if tag in CLOSES:
            at = self.last(CLOSES[tag])
            if at > self.last(SCOPES[tag]):
                self.cut(at)
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "a":
            self.link = 0
        elif self.open.get(tag):
            self.cut(self.open[tag][-1])


def _parsed(html: str) -> _Tree:
    tree, at = _Tree(), 0
    while at < len(html):
        m = MARKUP.search(html, at)
        upto = m.start() if m else len(html)
        if upto > at:
            tree.text.append((tree.stack[-1], html[at:upto], tree.link > 0))
        if m is None:
            break
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
        elif m[2] is not None:
            tag = m[2].lower()
            if m[1]:
                tree.end(tag)
            elif tag in RAW:
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            else:
                tree.start(tag, m[3])
    tree.flush()
    tree.cut(1)
    tree.spans[0][1] = len(tree.blocks)
    return tree


def _spared(tree: _Tree, out_by_kind: list[bool], hidden: list[bool]) -> set[int]:
    """Containers and forms that id, class or being a form would leave out, though they hold most of the page's text outside links."""
    for k, (a, b) in enumerate(tree.spans):
        if tree.tags[k] in {"article", "main"} and not hidden[k]:
            pieces = (x for block in tree.blocks[a:b] for x in block)
            if any(not in_link and not hidden[node] and not t.isspace() for node, t, in_link in pieces):
                return set()
    letters = [0]  # up to each block, of what isn't left out by tag or role
    for block in tree.blocks:
        letters.append(letters[-1] + plain_letters([(t, in_link) for node, t, in_link in block if not out_by_kind[node]]))
    named = (k for k, x in enumerate(tree.by_name) if x and not out_by_kind[k] and tree.tags[k] in SPARED)
    return {k for k in named if letters[tree.spans[k][1]] - letters[tree.spans[k][0]] > letters[-1] / 2}


def page_of(html: str | None) -> Page:
    """The blocks and containers of a page that aren't left out."""
    tree = _parsed(html or "")

    def left_out(spared: set[int], names: bool = True) -> list[bool]:
        out = [False]
        for k in range(1, len(tree.tags)):
            out.append(out[tree.parents[k]] or tree.by_kind[k] or names and tree.by_name[k] and k not in spared)
        return out

    hidden = left_out(set())
    if any(tree.by_name):
        spared = _spared(tree, left_out(set(), names=False), hidden)
        hidden = left_out(spared) if spared else hidden
    blocks, sums = [], [(0, 0, 0)]
    upto = [0]  # kept blocks before each block
    for block in tree.blocks:
        text = [(t, in_link) for node, t, in_link in block if not hidden[node]]
        joined = " ".join(unescape("".join(t for t, _ in text)).split())
        if joined:
            blocks.append(joined)
            letters, linked, plain = sums[-1]
            sums.append((letters + len(joined), linked + sum(len(t) for t, in_link in text if in_link), plain + plain_letters(text)))
        upto.append(len(blocks))
    found = []
    for k, (a, b) in enumerate(tree.spans):
        if not hidden[k] and (k == 0 or tree.labels[k]):
            first, last = upto[a], upto[b]
            found.append(Container(tree.paths[k], k, first, last, *(y - x for x, y in zip(sums[first], sums[last], strict=True))))
    return Page(blocks, found, tree.parents, tree.labels)


def best_of(found: list[Container]) -> Container:
    """The container to vote for: the deepest one that holds all of the page's text outside links, or else the whole page."""
    page = found[0]
    return [c for c in found if c.plain == page.plain][-1] if page.plain else page


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0, 0.0])
        for host, html in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
            best = best_of(page_of(html).containers)
            if best.last > best.first:
                total[host, best.path][0] += 1
                total[host, best.path][1] += round(best.score, 1)
        rows = [(h, p, int(n), s) for (h, p), (n, s) in total.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "votes", "score"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and path: the hash of the path with the most votes of each host's pages (url, html)."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, votes long, score double")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum(F.col("score").cast("decimal(30,1)")).alias("score"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def text_by_path(html: str | None, path: str | None) -> tuple[str, str]:
    """The text of the containers with the path (a hash), or else of the page's best one, and the path used, in full."""
    page = page_of(html)
    chosen = [c for c in page.containers if c.path == path and c.last > c.first] or [best_of(page.containers)]
    return "\n".join(b for c in chosen for b in page.blocks[c.first : c.last]), page.path_of(chosen[0])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and path (the one used) of each row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    winners = materialise(winning_paths(pages), "html-paths")
    both = pages.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [text_by_path(h, p) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                texts, paths = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(paths, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return both.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")

"""Main text of web pages by wrapper induction.

Pages of one host share templates. Every page is parsed into a tree, and nodes
with equal path and text are counted over all pages of the host. A node is template
if SHARE of the distinct articles that have its path have its text there too, so
each layout is judged by the pages that have it and copies of an article count
once. This is simple tree matching of all pages of a host at once: nodes align
where their paths are equal, whatever stands beside them. A page's container is what holds the running text that is no template; where
pages of one layout disagree, the commonest container holds for all of them.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.work import keep

# Elements without an end tag, elements that break a line, elements
# that are no article text, and words in class or id that mark the same. LOOSE
# words also name parts of articles: inside of one they count only where links
# make up the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NOT_TEXT = frozenset("head script style noscript template nav footer aside form iframe object svg canvas button select textarea menu dialog title".split())
NOT_TEXT_WORDS = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|notice|alert|menu|nav\w*|sidebar|comments?|replies|breadcrumbs?|newsletter|subscribe|signup|login|popup|modal|footer|masthead|skip)(?:$|[-_ ])")
LOOSE_WORDS = re.compile(r"(?:^|[-_ ])(?:side|related|social|share|sharing|respond|widget)(?:$|[-_ ])")
CLOSES_P = BLOCK - {"br", "option", "title", "caption", "legend", "summary"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Part of a path's distinct articles, and their least number, that make an equal text template.
SHARE, LEAST = 0.5, 3
#: Part of a text in links from which a loosely marked part of an article is a list of links.
LINKS = 0.3
SECTIONS = frozenset("body div section td center article main".split())
HEADINGS = frozenset("h1 h2 h3".split())


class Node:
    __slots__ = ("tag", "mark", "children")

    def __init__(self, tag: str, mark: str = "") -> None:
        self.tag, self.mark, self.children = tag, mark, []

    def own(self) -> str:
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Reader(HTMLParser):
    """A tree from any mark-up, however deep: unclosed and stray tags are taken as browsers do in the common cases."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.path = [self.root]
        self.open: Counter[str] = Counter()

    def _drop(self, i: int) -> None:
        for node in self.path[i:]:
            self.open[node.tag] -= 1
        del self.path[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, CLOSES_P - {"p"})
        if tag in SAME:
            self._close(SAME[tag], SCOPE[tag])
        mark = ""
        if attrs:
            found = dict(attrs)
            mark = " ".join(" ".join(filter(None, (found.get("class"), found.get("id"), found.get("role")))).lower().split())
        node = Node(tag, mark)
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.path.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tags: set[str], stop: set[str] | frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].tag in tags:
                self._drop(i)
                return
            if self.path[i].tag in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            self._drop(max(i for i in range(len(self.path)) if self.path[i].tag == tag) if self.path[-1].tag != tag else len(self.path) - 1)

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)


def parse(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def _links(top: Node) -> bool:
    """Whether links make up LINKS of a node's text at least."""
    size = linked = 0
    todo = [(top, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag == "a"
        for c in node.children:
            if isinstance(c, str):
                size += len(c.strip())
                linked += len(c.strip()) if inside else 0
            else:
                todo.append((c, inside))
    return linked >= LINKS * max(size, 1)


@lru_cache(maxsize=1 << 14)
def _marked(mark: str) -> tuple[bool, bool]:
    return bool(NOT_TEXT_WORDS.search(mark)), bool(LOOSE_WORDS.search(mark))


def dropped(node: Node, inside: bool) -> bool:
    """Whether a node is no article text. A header counts as one only outside of the container."""
    if node.tag in NOT_TEXT or node.tag == "header" and not inside:
        return True
    if not node.mark or node.tag in ("html", "body", "article", "main"):
        return False
    plain, loose = _marked(node.mark)
    return plain or loose and (not inside or _links(node))


def _key(text: str) -> int:
    """A signed 64-bit name of a text."""
    n = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


@lru_cache(maxsize=1 << 16)
def _below(path: int, tag: str, mark: str) -> int:
    """The path of a node below another; pages of a host repeat theirs."""
    return _key(f"{path} {tag} {mark}")


def _walk(root: Node) -> Iterator[tuple[Node, int, int, int, bool]]:
    """Nodes that may hold article text, in page order: node, path, its parent's path, depth, whether inside of an article.
    A path is named by a hash of its parent's name and the node's tag and mark; the root's is 0."""
    todo = [(root, 0, 0, 0, False)]
    while todo:
        node, path, parent, depth, inside = todo.pop()
        if depth:
            yield node, path, parent, depth, inside
        for child in reversed(node.children):
            if isinstance(child, str):
                continue
            within = inside or child.tag in ("article", "main")
            if not dropped(child, within):
                todo.append((child, _below(path, child.tag, child.mark), path, depth + 1, within))


def constants(html: str) -> tuple[int, set[tuple[int, int]]]:
    """A page's article, by its first heading and longest text, and the (path, text) of its nodes that may be template."""
    head, longest, out = "", "", set()
    for node, path, *_ in _walk(parse(html)):
        if text := node.own():
            if node.tag in HEADINGS:
                head = head or text
            else:
                out.add((path, _key(text)))
            if node.tag != "a" and len(text) > len(longest):
                longest = text
    return _key(f"{head}\n{longest}"), out


def container(root: Node, fixed: frozenset[tuple[int, int]]) -> tuple[int, int, int]:
    """A page's layout, by its outer sections, and path and depth of the container of its running text."""
    weight: dict[int, int] = {0: 0}
    about: dict[int, tuple[int, int, Node]] = {}
    outer: set[int] = set()
    for node, path, parent, depth, _ in _walk(root):
        if node.tag in SECTIONS and depth <= 4:
            outer.add(path)
        about.setdefault(path, (parent, depth, node))
        weight.setdefault(path, 0)
        text = node.own()
        if text and node.tag != "a" and (node.tag in HEADINGS or not fixed or (path, _key(text)) not in fixed):
            weight[path] += len(text)
    for path in reversed(about):  # parents stand before their children
        weight[about[path][0]] += weight[path]
    layout = _key(str(sorted(outer)))
    full = {p: w for p, w in weight.items() if p and w}
    if not full:
        return layout, 0, 0
    depth = lambda p: about[p][1]
    named = [p for p in full if about[p][2].tag in ("article", "main") or "main" in about[p][2].mark.split()]
    if named:
        path = max(named, key=lambda p: (full[p], -depth(p)))

        def below(p: int) -> bool:
            while p and p != path:
                p = about[p][0]
            return p == path

        inner = [p for p in named if about[p][2].tag == "article" and full[p] >= 0.5 * full[path] and below(p)]
        path = max(inner, key=depth, default=path)
        return layout, path, depth(path)
    total = max(full.values())
    path = max((p for p in full if full[p] >= 0.8 * total and about[p][2].tag in ("body", "div", "section", "td", "center")), key=depth, default=0)
    return layout, path, depth(path) if path else 0


@lru_cache(maxsize=256)
def _wrapper(fixed: str | None, votes: str | None) -> tuple[frozenset[tuple[int, int]], dict[int, int]]:
    return frozenset((x["p"], x["t"]) for x in json.loads(fixed or "[]")), {x["layout"]: x["path"] for x in json.loads(votes or "[]")}


def extract(html: str | None, fixed: str | None = None, votes: str | None = None) -> str:
    """The page's text through its host's wrapper: template nodes, and containers of layouts whose pages disagree, as JSON.

    Where template would be more than half of a container's text, pages of the
    host are copies of one another: then nothing in it is template.
    """
    if not html or not html.strip():
        return ""
    constant, agreed = _wrapper(fixed, votes)
    root = parse(html)
    layout, own, _ = container(root, constant)
    found = _containers(root, agreed.get(layout, own)) or _containers(root, own)
    parts: list[str] = []
    for node, path in found:
        mine, gone = _gather(node, path, constant)
        if gone > sum(map(len, mine)):
            mine, _ = _gather(node, path, frozenset())
        parts += [" ", *mine]
    return " ".join("".join(parts).split())


def _gather(top: Node, path: int, constant: frozenset[tuple[int, int]]) -> tuple[list[str], int]:
    """Pieces of text below a node, a space at each block's edges, and the length of what was template."""
    parts: list[str] = []
    gone = 0
    todo: list[str | tuple[Node, int]] = [(top, path)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        node, path = item
        text = node.own() if constant and node.tag not in HEADINGS else ""
        fixed = bool(text) and (path, _key(text)) in constant
        gone += len(text) if fixed else 0
        for c in reversed(node.children):
            if isinstance(c, str):
                if not fixed:
                    todo.append(c)
            elif not dropped(c, True):
                edge = [" "] if c.tag in BLOCK else []
                todo += [*edge, (c, _below(path, c.tag, c.mark)), *edge]
    return parts, gone


def _containers(root: Node, path: int) -> list[tuple[Node, int]]:
    """The nodes with a container's path, and that path; the root has path 0."""
    return [(n, p) for n, p, *_ in _walk(root) if p == path] if path else [(root, 0)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    All pages of a host are counted for its wrapper; a host with a third of all
    rows is counted in parts. Null and empty pages have empty text; pages
    without a host share the empty host. Repeated rows and null ids keep their
    own rows; an empty table gives an empty result; other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(h, article, p, t) for h, x in zip(b.column("host").to_pylist(), b.column("html")) for article, pairs in [constants(x.as_py())] for p, t in pairs]
            hosts, *ids = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(c, pa.int64()) for c in ids]], names=["host", "article", "p", "t"])

    seen = keep(rows.where("html is not null").select("host", "html").mapInArrow(count, "host string, article long, p long, t long").distinct(), "nodes")
    articles = seen.select("host", "p", "article").distinct().groupBy("host", "p").agg(F.count("*").alias("articles"))
    fixed = seen.groupBy("host", "p", "t").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).join(articles, ["host", "p"]).where(F.col("n") >= SHARE * F.col("articles"))
    fixed = keep(fixed.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("p", "t")))).alias("fixed")), "template")
    rows = rows.join(fixed, "host", "left")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [container(parse(x.as_py()), _wrapper(f.as_py(), None)[0]) for x, f in zip(b.column("html"), b.column("fixed"))]
            layout, path, depth = zip(*got) if got else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(layout, pa.int64()), pa.array(path, pa.int64()), pa.array(depth, pa.int32())], names=["host", "layout", "path", "depth"])

    votes = rows.where("html is not null").select("host", "html", "fixed").mapInArrow(vote, "host string, layout long, path long, depth int").groupBy("host", "layout", "path", "depth").agg(F.count("*").alias("n"))
    votes = votes.groupBy("host", "layout").agg(F.count("*").alias("paths"), F.min(F.struct(-F.col("n"), "depth", F.col("path").alias("path"))).alias("best")).where("paths > 1")
    votes = keep(votes.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("layout", F.col("best.path").alias("path"))))).alias("votes")), "votes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h.as_py(), f.as_py(), v.as_py()) for h, f, v in zip(b.column("html"), b.column("fixed"), b.column("votes"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.join(votes, "host", "left").select("page_id", "url", "html", "fixed", "votes").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")

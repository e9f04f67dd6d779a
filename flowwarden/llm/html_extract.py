"""Main text of web pages by a site style tree.

The element trees of all pages of a host are merged by path (tag, class and id
from the body down). A node's content importance is one minus the mean entropy
of its texts over the host's pages: 0 if every page shows the same texts, 1 if
each shows its own. Its presentation importance is the entropy of its child
sequences. Branches that are low in both, on enough pages, are the site's frame
and go from each page; so does each text that most pages show at one place, though
its neighbours vary. Pages of one text count once, and a page keeps such texts
if little else would be left of it: copies of an article are no frame. Elements
whose name, role or class says that they aren't article text go too, which also
serves hosts of few pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: A branch goes if both importances are below this,
LOW = 0.2
#: and at least this many of its host's pages show it.
MIN_PAGES = 10
#: Elements other than containers, and single texts, stay on a page of which less
#: than this percentage of words would be left.
LEAST_PCT = 10
#: Beside article and main elements that hold most of a page, blocks of so many words stay.
LONG = 25
#: Levels of the style tree. Elements below are no nodes of their own: their texts count for the one above.
TREE_DEPTH = 64
#: Paths of low importance (8 bytes each) that are sent to every task; more are joined by host.
BROADCAST_PATHS = 1_000_000

# Element names and attribute words.
RAW = frozenset("script style textarea title noscript template iframe svg select object xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
                  "tfoot th thead tr ul".split())
CONTAINER = frozenset("aside center details div dl fieldset figure ol section span table ul".split())
#: Elements that can go as a whole. An article goes by its parts only.
MAIN = frozenset({"article", "main"})
BRANCH = (BLOCK | CONTAINER) - {"html", "body"} - MAIN
NOISE = frozenset("aside button dialog fieldset footer header input label menu nav search head".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
                        "breadcrumbs header masthead footer sidebar aside widget related share sharing social cookie cookies consent gdpr notice "
                        "notices notification popup modal overlay newsletter subscribe subscription signup login search comment comments reply "
                        "replies disqus discussion respond pagination pager toolbar copyright skip".split())
COMMENT_WORDS = frozenset("comment comments reply replies disqus discussion respond".split())
STATES = frozenset("no non not without with has is hide show open closed enabled disabled fixed sticky".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("article aside body div footer form header html main nav section table td th ul ol dl".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(["'])|([^\s>]*)))?)""")
_PARTS = re.compile(r"[^a-z]+")


class Node:
    """An element. ``tree`` is the element of the style tree that its texts count
    for: itself, or its ancestor at ``TREE_DEPTH``. ``named``: a part of its class
    or id is a noise word. ``mute``: text directly in it is dropped when read."""
    __slots__ = ("tag", "up", "path", "tree", "place", "depth", "noise", "main", "named", "mute", "kids", "inputs", "words", "mains")

    def __init__(self, tag: str, up: Node | None, name: str, path: int):
        self.tag, self.up, self.path = tag, up, path
        self.depth = up.depth + 1 if up else 0
        self.tree = self if self.depth <= TREE_DEPTH else up.tree
        holds = up is None or self.tree is self and (tag in BRANCH or tag in MAIN)
        self.place = self if holds else up.place
        self.main = bool(up and up.main) or tag in MAIN
        self.noise = self.mute = bool(up and up.noise)
        self.named = self.inputs = False
        self.kids: list[str] = []
        self.words = self.mains = 0


def _is_hidden(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    return (tag in NOISE and not (tag == "header" and in_main) or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            or attributes.get("role") in NOISE_ROLES or "display:none" in attributes.get("style", "").replace(" ", ""))


def _named(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[bool, bool]:
    """Whether a token of class or id is a noise word (or a compound of a comment
    word), and whether one is a compound of another noise word. Tokens that tell a
    state (no-sidebar, comments-open) tell nothing."""
    if tag in ("html", "body", "main", "h1"):
        return False, False
    whole, compound = False, False
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = set(_PARTS.split(token)) - {""}
        words = parts & NOISE_WORDS
        if not words or in_main and words <= {"header"} or parts & STATES:
            continue
        sure = len(parts) == 1 or bool(words & COMMENT_WORDS)
        whole, compound = whole or sure, compound or not sure
    return whole, compound


Block = tuple[str, Node]


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes from a position in a tag, the position after it, and whether it
    closes itself. A quote that never ends ends at the next >; a tag that never
    ends, with the page. Each character is read a fixed number of times."""
    found: dict[str, str] = {}
    while (m := _ATTRIBUTE.match(page, at)) is not None:
        at = m.end()
        if m[1]:
            return found, at, page[at - 2] == "/"
        value = m[4] or ""
        if m[3]:
            end = page.find(m[3], at)
            if end < 0:
                end = page.find(">", at)
                end = len(page) if end < 0 else end
                value, at = page[at:end], end
            else:
                value, at = page[at:end], end + 1
        found.setdefault(m[2].lower(), html.unescape(value))
    return found, len(page), False


def _raw_end(page: str, at: int, tag: str, ends: dict[str, re.Pattern]) -> int:
    if tag not in ends:
        ends[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.I)
    m = ends[tag].search(page, at)
    end = page.find(">", m.end()) if m else -1
    return len(page) if end < 0 else end + 1


def _judge(nodes: list[Node], found: list[Block]) -> None:
    """Marks noise that words decide. A form with a visible input goes unless it holds more than
    half of the page's words: then it is around the page. An element with a noise word within
    a class goes unless it holds more than half of the words and no article or main element stands outside it."""
    for text, n in found:
        if not n.noise:
            n.words += len(text.split())
    for n in nodes:
        n.mains = n.words if n.main else 0
    for n in reversed(nodes):
        if n.up:
            n.up.words += n.words
            n.up.mains += n.mains
            n.up.inputs |= n.inputs
    every, mains = nodes[0].words, nodes[0].mains
    for n in nodes[1:]:
        n.noise = (n.noise or n.up.noise or n.tag == "form" and n.inputs and 2 * n.words <= every
                   or n.named and (2 * n.words <= every or n.mains < mains))


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Elements of a page in order, parents first, and its text blocks, each with
    its innermost element. Time is linear in the page's length."""
    root = Node("html", None, "", 0)
    nodes, stack, out, buffer = [root], [root], [], []
    where: dict[str, list[int]] = {}  # places on the stack of open elements by tag
    scopes: list[int] = []
    paths: dict[tuple[int, str], int] = {}
    ends: dict[str, re.Pattern] = {}

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append((text, stack[-1]))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            n = stack.pop()
            where[n.tag].pop()
            if n.tag in SCOPE:
                scopes.pop()

    def say(text: str) -> None:
        if not stack[-1].mute:
            buffer.append(html.unescape(text))

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        t = _TAG.match(page, start)
        if t is None:
            if page.startswith(("<!", "<?", "</"), start):
                say(page[at:start])
                if page.startswith("<!--", start):
                    end = page.find("-->", start + 2)
                    at = size if end < 0 else end + 3
                else:
                    end = page.find(">", start)
                    at = size if end < 0 else end + 1
            else:
                say(page[at:start + 1])
                at = start + 1
            continue
        say(page[at:start])
        tag = t[2].lower()
        attributes, at, closed = _attributes(page, t.end())
        block = tag in BLOCK
        if t[1]:
            if block:
                flush()
            place = where.get(tag)
            if place and (tag in SCOPE or not scopes or place[-1] > scopes[-1]):
                close_to(place[-1])
            continue
        if tag in RAW:
            stack[-1].inputs |= tag in ("select", "textarea")
            if not (closed and tag in ("svg", "object")):
                at = _raw_end(page, at, tag, ends)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if block:
            flush()
            closes = CLOSES.get(tag, set()) | {"p"}
            while (last := max((where[c][-1] for c in closes if where.get(c)), default=-1)) >= (scopes[-1] if scopes else 0) and last > 0:
                close_to(last)
        if tag == "button" or tag == "input" and attributes.get("type", "").lower() != "hidden":
            stack[-1].inputs = True
        if tag in VOID or tag in ("html", "body"):
            continue
        up = stack[-1]
        name = ".".join([tag, *sorted(attributes.get("class", "").split()), attributes.get("id", "")]) if attributes else tag
        if up.depth >= TREE_DEPTH:
            path = up.path
        elif (path := paths.get((up.path, name))) is None:
            path = paths[up.path, name] = _hash(f"{up.path}\n{name}")
        node = Node(tag, up, name, path)
        up.tree.kids.append(name)
        hidden = _is_hidden(tag, attributes, up.main)
        whole, node.named = _named(tag, attributes, up.main) if attributes else (False, False)
        node.noise |= hidden or whole
        node.mute = up.mute or hidden or node.noise and block
        nodes.append(node)
        if not closed:
            where.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append(node)
    say(page[at:])
    flush()
    _judge(nodes, out)
    return nodes, [(text, n) for text, n in out if not n.noise]


def _words(found: list[Block]) -> int:
    return sum(len(text.split()) for text, _ in found)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def article(page: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page without the branches and texts in ``low``. If article
    or main elements hold at least half of its words, blocks outside them stay only
    if they have ``LONG`` words or more."""
    nodes, found = parse(page)
    if low:
        container, branch = set(), set()  # elements in a branch of low importance
        for n in nodes:
            if n.up and id(n.up) in container or n.tree is n and n.tag in CONTAINER and n.path in low:
                container.add(id(n))
            if n.up and id(n.up) in branch or n.tree is n and n.tag in BRANCH and n.path in low:
                branch.add(id(n))
        found = [(text, n) for text, n in found if id(n) not in container]
        rest = [(text, n) for text, n in found if id(n) not in branch and n.place.path ^ _hash(text) not in low]
        if 100 * _words(rest) >= LEAST_PCT * _words(found):
            found = rest
    main = [(text, n) for text, n in found if n.main]
    if 2 * _words(main) >= _words(found):
        found = [(text, n) for text, n in found if n.main or len(text.split()) >= LONG]
    return "\n".join(text for text, _ in found)


NODES = "page long, nodes array<struct<path:long,container:boolean,branch:boolean,style:long,texts:array<long>>>"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its nodes that hold text: path, child sequence and texts, as
    hashes, and a hash of them all. Elements that don't go as a whole hold their
    own texts only."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("container", pa.bool_()), ("branch", pa.bool_()), ("style", pa.int64()), ("texts", pa.list_(pa.int64()))]))
    for batch in batches:
        pages, rows = [], []
        for page in batch.column(1):
            found: dict[int, tuple[Node, set[int]]] = {}
            for text, inner in parse(page.as_py() or "")[1]:
                h, n = _hash(text), inner.tree
                while n:
                    if n.tag in BRANCH or n is inner.place:
                        found.setdefault(n.path, (n, set()))[1].add(h)
                    n = n.up
            row = [{"path": path, "container": n.tag in CONTAINER, "branch": n.tag in BRANCH, "style": _hash(" ".join(n.kids)), "texts": sorted(texts)}
                   for path, (n, texts) in found.items()]
            pages.append(_hash(repr(sorted((n["path"], n["style"], n["texts"]) for n in row))))
            rows.append(row)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.int64()), pa.array(rows, kind)], ["host", "page", "nodes"])


def _tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, html) -> host, path, container, branch, pages, content, presentation of
    each node; and host, path, text, n, pages of the texts that several pages show.
    Pages of the same nodes count once."""
    found = written(pages.mapInArrow(_nodes, f"host string, {NODES}").dropDuplicates(["host", "page"]), "page-nodes")
    nodes = found.select("host", F.inline("nodes"))
    kind = ["host", "path"]
    in_pages = lambda n: F.when(F.col("pages") > 1, F.log(n) / F.log("pages")).otherwise(F.lit(0.0))
    share = F.col("n") / F.col("pages")
    of = nodes.groupBy(*kind, "style").agg(F.count(F.lit(1)).alias("n"), F.first("container").alias("container"), F.first("branch").alias("branch"))
    pages_of = of.groupBy(*kind).agg(F.sum("n").alias("pages"))
    texts = nodes.select(*kind, F.explode("texts").alias("text")).groupBy(*kind, "text").agg(F.count(F.lit(1)).alias("n"))
    # a text of one page adds log(1) = 0: such texts are only counted
    number = texts.groupBy(*kind).agg(F.count(F.lit(1)).alias("texts"))
    often = texts.filter("n > 1").join(pages_of, kind)
    content = (number.join(often.groupBy(*kind).agg(F.sum(in_pages(F.col("n"))).alias("entropy")), kind, "left")
               .select(*kind, (1 - F.coalesce("entropy", F.lit(0.0)) / F.col("texts")).alias("content")))
    style = (of.join(pages_of, kind).groupBy(*kind)
             .agg(F.first("container").alias("container"), F.first("branch").alias("branch"), F.first("pages").alias("pages"),
                  F.sum(-share * F.when(F.col("pages") > 1, F.log(share) / F.log("pages")).otherwise(F.lit(0.0))).alias("presentation")))
    return style.join(content, kind), often.select(*kind, "text", "n", "pages", (1 - in_pages(F.col("n"))).alias("content"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, html) -> host, path, pages, content, presentation: the importances
    of each container node of each host."""
    return _tree(pages)[0].filter("container").select("host", "path", "pages", "content", "presentation")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url and text of each row, from its whole html.

    Templates are found first and sent to where the html was read, which isn't shuffled
    then. Blocks are joined by a line feed; a page without main text, or without html, has
    an empty text; broken and cut-off markup ends with the page; rows that share
    an id are extracted each for itself; a null url is a host of its own; an empty
    table gives no rows. Other columns are not read."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    nodes, texts = _tree(p.select("host", "html"))
    branches = nodes.filter(F.col("branch") & (F.col("pages") >= min_pages) & (F.col("content") < low) & (F.col("presentation") < low)).select("host", "path")
    single = texts.filter((F.col("n") >= min_pages) & (F.col("content") < low)).select("host", F.col("path").bitwiseXOR(F.col("text")).alias("path"))
    frame = written(branches.unionByName(single).groupBy("host").agg(F.collect_set("path").alias("low")), "templates")  # the few templates of a host
    small = (frame.agg(F.sum(F.size("low") + 8)).first()[0] or 0) <= BROADCAST_PATHS
    frame = F.broadcast(frame) if small else frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(page.as_py() or "", frozenset(low.as_py() or ())) for page, low in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return p.join(frame, "host", "left").select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string")

"""Main text of web pages, with the templates of each host found by counting element subtrees."""

from __future__ import annotations

import html as entities
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save
from .urls import host_of

#: Element names of HTML by how they are treated here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd caption thead tbody tfoot tr th td option summary figcaption legend".split())
BOXES = frozenset("address aside center details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never text of a page, by the element's meaning.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas".split())
#: Beside the main text by the element's meaning, or by a word of its class, id or role: what counting can't tell.
CHROME = UNSEEN | frozenset("button select textarea form nav header footer aside dialog menu".split())
CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent notice newsletter subscribe signup popup modal share sharing social related comment comments disqus respond pagination pager toolbar widget".split())
HEAD_WORDS = frozenset("header masthead banner".split())
#: Parts of names that tell a state of something else.
STATE_WORDS = frozenset("has no not is with without open opened closed enabled disabled layout".split())
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
P_ENDS = BLOCKS - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
P_HOLDERS = ("article", "main", "section", "div", "td", "th", "li", "body", "button")

START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
QUOTED = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
#: Templates of all hosts (16 MB) that go to every task; with more, each page is joined with those that it has.
MOST_TEMPLATES = 2_000_000
DIGITS = re.compile(r"[0-9]+")


class Node:
    """An element: tag, words of class, id and role, children and texts in order, and what is found out of it.

    `chrome`, `holds` (a main element) and `heads` (1: a heading below, 2: the page's) come from `mark`; `h`, `may` and `main` (exact subtrees), `shape` and
    `share` (shapes of subtrees) from `fingerprint`.
    """

    __slots__ = ("tag", "names", "items", "chrome", "holds", "heads", "prose", "linked", "h", "may", "main", "shape", "share")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.items = tag, names, []
        self.chrome = self.holds = self.may = False
        self.heads = self.prose = self.linked = 0
        self.main = self.shape = self.share = None


def parse(page: str) -> Node:
    """The element tree, as browsers repair it in the common cases: implied ends, stray ends, cut files.

    Takes time in proportion to the page: a quote or tag that never ends is looked for once, not for each
    element before it.
    """
    sys.setrecursionlimit(1_000_000)  # deep trees: calls between Python functions need no C stack
    tree, at, quotes = _Tree(), 0, True
    while True:
        m = START.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            tree.top.items.append(entities.unescape(text))
        if not m:
            return tree.root
        tag, at = m[2], m.end()
        if tag is None and m[0] == "<!--":
            ended = COMMENT_END.search(page, at)
            if not ended:
                return tree.root
            at = ended.end()
            continue
        end = page.find(">", at)
        if end < 0:  # no tag ends from here on
            rest = page[m.start() :].split("<!--", 1)[0]
            tree.top.items.append(entities.unescape(rest))
            return tree.root
        if tag is None:
            at = end + 1
            continue
        if quotes and end > at:
            stop = QUOTED.match(page, at).end()
            if stop < len(page) and page[stop] != ">":  # a quote that is never closed
                stop = page.find(">", stop)
            if 0 <= stop < len(page):
                end = stop
            else:
                quotes = False
        rest, at = page[at:end], end + 1
        tag = tag.lower()
        if m[1]:
            if tree.at.get(tag):
                tree.close((tag,), ())
            continue
        if tag in P_ENDS and tree.at.get("p"):
            tree.close(("p",), P_HOLDERS)
        if tag in CLOSES:
            tree.close(*CLOSES[tag])
        node = Node(tag, " ".join(v or w or x for _, v, w, x in ATTRIBUTE.findall(rest)) if rest else "")
        tree.top.items.append(node)
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            node.items.append(page[at : close.start() if close else len(page)])
            if not close:
                return tree.root
            at = page.find(">", close.end()) + 1 or len(page)
        elif tag not in VOID and not rest.endswith("/"):
            tree.open(node)


class _Tree:
    def __init__(self):
        self.root = Node("html")
        self.stack, self.top = [self.root], self.root
        self.at: dict[str, list[int]] = {}

    def open(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)
        self.top = node

    def close(self, names, within) -> None:
        """End the innermost open element of `names`, unless one of `within` is nearer."""
        deepest = max((self.at[n][-1] for n in names if self.at.get(n)), default=0)
        if not deepest or any(self.at[n][-1] > deepest for n in within if self.at.get(n)):
            return
        while len(self.stack) > deepest:
            self.at[self.stack.pop().tag].pop()
        self.top = self.stack[-1]


def is_main(node: Node) -> bool:
    return node.tag not in CHROME and (node.tag in ("article", "main") or "main" in node.names.split())


def is_marked(node: Node, inside: bool = False) -> bool:
    """Whether a class, id or role is a word for what stands beside the main text, or begins or ends with one.

    Names that tell a state (has-sidebar, comments-open) say nothing about the element itself. Inside a main
    element composite names are about boxes alone, and those of heads not about boxes with a heading: share-price
    may be a paragraph's, post-header the heading's.
    """
    if not node.names or node.tag in ("html", "body"):
        return False
    for name in node.names.lower().split():
        parts = [x for x in re.split(r"[_-]+", name) if x]
        if not parts or STATE_WORDS.intersection(parts):
            continue
        word = next((x for x in (parts[0], parts[-1]) if x in CHROME_WORDS), None)
        if word is None:
            continue
        if len(parts) > 1 and inside and (node.tag not in BOXES or word in HEAD_WORDS and node.heads):
            continue
        return True
    return False


def mark(root: Node) -> None:
    """Set `holds`, `heads`, `prose` and `linked` (characters outside and inside links) and `chrome` of every element.

    `chrome` is by name, or by a word of class, id or role. A main element is never judged by its words. An
    element that holds one is only if another main element stands beside it: it is a layout around the text
    then no longer, but a list of teasers or comments. Nor can names leave less than a twentieth of the page's
    text: then forms and elements known by a word alone, the first with a quarter of the text, are layouts too.
    """

    def measure(node: Node, link: bool) -> bool:
        found = False
        for x in node.items:
            if isinstance(x, str):
                n = len(x) if x.strip() else 0
                if link:
                    node.linked += n
                else:
                    node.prose += n
            elif x.tag not in UNSEEN:
                found = measure(x, link or x.tag == "a") or found
                node.prose += x.prose
                node.linked += x.linked
                node.heads = max(node.heads, x.heads, 2 if x.tag == "h1" else x.tag in HEADINGS)
        node.holds = found
        return found or is_main(node)

    def walk(node: Node, around: list[tuple[Node, bool]], inside: bool) -> bool:
        clean = False
        for x in node.items:
            if isinstance(x, str):
                continue
            if x.tag in UNSEEN:
                x.chrome = True
            elif is_main(x):
                clean = walk(x, around, True) or clean or x.tag == "article" or not x.holds
            elif x.tag not in CHROME and not is_marked(x, inside) or id(x) in layouts:
                clean = walk(x, around, inside) or clean
            elif x.holds:
                around.append((x, inside))
            else:
                x.chrome = True
        return clean

    def clear(node: Node) -> None:
        for x in node.items:
            if not isinstance(x, str):
                x.chrome = False
                clear(x)

    def judge() -> None:
        todo = [(root, False)]
        while todo:
            around: list[tuple[Node, bool]] = []
            node, inside = todo.pop()
            if walk(node, around, inside):
                for x, _ in around:
                    x.chrome = True
            else:
                todo += around

    def kept(node: Node, inside: bool, link: bool) -> int:
        n = 0
        for x in node.items:
            if isinstance(x, str):
                n += len(x) if inside and not link and x.strip() else 0
            elif not x.chrome:
                n += kept(x, inside or is_main(x), link or x.tag == "a")
        return n

    def first(node: Node) -> Node | None:
        for x in node.items:
            if isinstance(x, str) or x.tag in UNSEEN or 4 * x.prose < root.prose:
                continue
            if x.chrome and (x.tag == "form" or x.tag not in CHROME):
                return x
            if not x.chrome and (found := first(x)):
                return found
        return None

    layouts: set[int] = set()
    measure(root, False)
    judge()
    while root.prose and 20 * kept(root, not root.holds, False) < root.prose and (found := first(root)):
        layouts.add(id(found))
        clear(root)
        judge()


def fingerprint(root: Node, host: str = "") -> None:
    """Hash every element's subtree, and the shape of those that stand beside the main text, for one host: equal
    subtrees of other hosts have other hashes, so that a hash alone is what is counted.

    Exact: names and texts. A subtree `may` be a template unless it is or holds a main element, or is a heading or a
    part of a list or table in one, which mean nothing by themselves. `main` is a hash of the text, without
    chrome, of the innermost main element around; None outside.

    Shape: names without digits, whether there are texts and links, and the kinds of shapes below; texts are left
    out. Menus, adverts and footers that say something else on every page have one shape on all of them.
    Only boxes have one that counts (`share` is set: which part of the page's text they are): outside main
    elements where there are any, else outside the smallest element with half of the page's text, or made of
    links; and not with the page's heading.
    """
    marked, seed = root.holds, xxhash.xxh64(host.encode("utf-8", "surrogatepass")).intdigest()
    path = [] if marked else _region(root)
    region, around_region = path[-1] if path else None, set(map(id, path))

    def visit(node: Node, texts: list, inside: list, shown: bool, within_text: bool) -> bytes:
        main = is_main(node)
        within_text = within_text or main or node is region
        if main:
            around, texts, inside = texts, [], []
        h, holds, within = xxhash.xxh64(f"{node.tag}|{node.names}", seed=seed), main, inside is not None
        kinds = set()
        for x in node.items:
            if isinstance(x, str):
                text = SPACE.sub(" ", x).strip().encode("utf-8", "surrogatepass")
                h.update(b"t" + text)
                if within and shown and text:
                    texts.append(text)
            else:
                h.update(b"e" + visit(x, texts, inside, shown and not x.chrome, within_text))
                holds = holds or x.may is None
                if x.shape is not None:
                    kinds.add(x.shape)
        node.h = h.intdigest() - (1 << 63)
        # None: is or holds a main element
        node.may = None if holds else not (within and node.tag in PARTS) and node.tag in BLOCKS and node.tag not in ("html", "body", "br", "hr")
        if not holds and not (marked and within_text) and node.tag in BLOCKS:
            own = f"{node.tag}|{DIGITS.sub('0', node.names)}|{node.prose > 0}|{node.linked > 0}|{sorted(kinds)}"
            node.shape = xxhash.xxh64(own, seed=seed ^ 1).intdigest() - (1 << 63)
            beside = not within_text or node is not region and node.linked > node.prose
            if beside and node.tag in BOXES and node.prose + node.linked and (marked or id(node) not in around_region and node.heads < 2):
                node.share = node.prose / max(1, root.prose)
        if main:
            own = xxhash.xxh64(b"\n".join(texts)).intdigest() - (1 << 63)
            for n in inside:
                n.main = own
            if around is not None and shown:
                around.append(b"\n".join(texts))
        elif within:
            inside.append(node)
        return h.digest()

    visit(root, None, None, True, False)


def _region(root: Node) -> list[Node]:
    """From the root down to the smallest element that holds at least half of the text outside links."""
    path = [root]
    while True:
        below = next((x for x in path[-1].items if not isinstance(x, str) and x.tag not in UNSEEN and 2 * x.prose >= root.prose > 0), None)
        if below is None:
            return path
        path.append(below)


def subtree_hashes(root: Node, host: str = "") -> tuple[set[tuple[int, int | None]], dict[int, float]]:
    """What is counted of a page: (hash, main element around) of exact subtrees, and shares of shapes."""
    exact, shapes = set(), {}

    def walk(node: Node) -> None:
        if node.may:
            exact.add((node.h, node.main))
        if node.share is not None:
            shapes[node.shape] = shapes.get(node.shape, 0.0) + node.share
        for x in node.items:
            if not isinstance(x, str):
                walk(x)

    mark(root)
    fingerprint(root, host)
    walk(root)
    return exact, shapes


def main_text(root: Node, templates: frozenset, by_name: bool = True) -> tuple[str, int, int]:
    """(text, elements deleted by counting, elements left out by name), after `subtree_hashes`.

    The text is of the blocks of the main elements, or of the whole page where none is marked. Without
    `by_name` that is left to counting alone.
    """
    mains: list[Node] = []
    counted = listed = 0

    def gone(node: Node) -> bool:
        nonlocal counted, listed
        if node.may and node.h in templates or node.share is not None and node.shape in templates:
            counted += node.prose + node.linked > 0
            return True
        if node.chrome and (by_name or node.tag in UNSEEN):
            listed += node.tag not in UNSEEN and node.prose + node.linked > 0
            return True
        return False

    def look(node: Node) -> None:
        nonlocal listed
        for x in node.items:
            if not isinstance(x, str) and not gone(x):
                if is_main(x):
                    mains.append(x)
                elif x.holds:
                    look(x)
                else:
                    listed += x.prose + x.linked > 0

    if by_name and root.holds:
        look(root)
    blocks, now = [], []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(now)).strip()
        if line:
            blocks.append(line)
        now.clear()

    def read(node: Node) -> None:
        for x in node.items:
            if isinstance(x, str):
                now.append(x)
            elif not gone(x):
                if x.tag in BLOCKS:
                    flush()
                    read(x)
                    flush()
                else:
                    read(x)

    if not mains:
        counted = listed = 0  # the page is read from its root, and told again
    for m in mains or [root]:
        flush()
        read(m)
    flush()
    return "\n".join(blocks), counted, listed


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 10, max_share: float = 0.3, by_name: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates, n_listed) for each page.

    Every element subtree is hashed and counted per host, in two ways; those on at least `min_pages` distinct
    pages are templates, which are deleted with all they hold (`n_templates` of a page):

    * with its names and texts. Those inside a main element must be in as many main elements of different text:
      copies of one article count once.
    * by shape alone, for boxes beside the main text: menus, adverts and footers made for each page. On
      average they must be at most `max_share` of the text of the pages that have them.

    The hashes of templates are counted: up to `MOST_TEMPLATES` of them go to the pages, which then never move.

    What a host has too few pages to tell is left out by the element's meaning, or by a word of its class, id or
    role (`n_listed`; nothing is without `by_name`). Where a page marks its main element, only that is read. Character references are
    decoded, white space in a block becomes one space, blocks are joined by \\n.

    A null or empty page has an empty text. Pages without a URL count as one host. Rows of one id are one
    page for the deletion: what is a template for one of them is for all. An empty table gives an empty table.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    host = host_of(F.col("url")).alias("host")

    def hash_all(batches):
        for b in batches:
            rows = []
            for page, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                exact, shapes = subtree_hashes(parse(text), name)
                rows += [(page, h, main, None) for h, main in exact]
                rows += [(page, h, None, share) for h, share in shapes.items()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float32()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "h", "main", "share"])

    subtrees = save(src.select("page_id", host, "html").mapInArrow(hash_all, "page_id long, h long, main long, share float"), "subtrees")
    often = save(subtrees.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select(F.col("h").alias("_h")), "frequent")
    seen = save(subtrees.join(often, F.col("h") == F.col("_h")).select("page_id", "h", "main", "share"), "frequent-places")
    # Two plain distinct counts: each place, page and main element is first made one row.
    of_page = seen.groupBy("h", "page_id").agg(F.count_if(F.col("main").isNull()).alias("m"), F.max("share").alias("share"))
    pages_of = of_page.groupBy("h").agg(F.count("*").alias("pages"), F.count_if(F.col("m") > 0).alias("outside"), F.avg("share").alias("share"))
    mains_of = seen.where("main is not null").select("h", "main").distinct().groupBy("h").agg(F.count("*").alias("mains"))
    enough = (F.col("pages") >= min_pages) & (F.col("outside") + F.coalesce("mains", F.lit(0)) >= min_pages) & F.coalesce(F.col("share") <= max_share, F.lit(True))
    templates = save(pages_of.join(mains_of, "h", "left").where(enough).select(F.col("h").alias("_h")), "templates")
    if templates.count() <= MOST_TEMPLATES:
        known, hits_of = src.select("page_id", "url", host, "html"), _held(templates)
    else:
        hits = seen.join(templates, F.col("h") == F.col("_h")).groupBy("page_id").agg(F.collect_set("h").alias("hits")).withColumnRenamed("page_id", "_page")
        known = src.join(save(hits, "template-hits"), F.col("page_id") == F.col("_page"), "left").select("page_id", "url", host, "html", "hits")
        hits_of = None

    def extract(batches):
        held = np.frombuffer(hits_of.value, np.int64) if hits_of is not None else None
        for b in batches:
            found = []
            given = b.column("hits").to_pylist() if held is None else [None] * b.num_rows
            for page, name, hits in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), given, strict=True):
                root = parse(page)
                mark(root)
                if held is not None and len(held) or hits:
                    fingerprint(root, name)
                if held is not None and len(held):
                    own = np.array(_counted(root), np.int64)
                    hits = own[held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own].tolist()
                found.append(main_text(root, frozenset(hits or ()), by_name))
            texts, counted, listed = zip(*found, strict=True) if found else ([], [], [])
            numbers = [pa.array(x, pa.int64()) for x in (list(map(len, texts)), counted, listed)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *numbers], ["page_id", "url", "text", "n_chars", "n_templates", "n_listed"])

    return known.mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_templates long, n_listed long")


def _held(templates: DataFrame):
    """The hashes of templates, sorted, eight bytes each, for all tasks."""
    found = templates.toArrow().column("_h").to_numpy()
    return templates.sparkSession.sparkContext.broadcast(np.sort(found.astype(np.int64)).tobytes())


def _counted(node: Node) -> list[int]:
    """All hashes of a page that may be templates."""
    out = [node.h] if node.may else []
    if node.share is not None:
        out.append(node.shape)
    for x in node.items:
        if not isinstance(x, str):
            out += _counted(x)
    return out

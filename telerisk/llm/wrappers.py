"""Main text of web pages by wrapper induction.

Pages of one host share a template.  A few pages of each host are parsed and their trees aligned by simple tree
matching: aligned nodes whose text is the same everywhere are template, the others are slots.  The element that
holds the varying text, outside of parts that are boilerplate by their nature (menus, forms, adverts and so on), is
the content slot.  The wrapper is the tree around that slot; matching a page's tree with it finds the page's own
slot, and the slot's blocks are the text.  A host may have several templates: its exemplars are grouped by the share
of their containers that match, and each group gives a wrapper.  A page takes the wrapper that fits it best; one that
fits none, and a single page, is treated as a host of its own.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.session import materialise

#: pages of a host that its wrappers are induced from, at most; different ones that show a block to be constant, at least
EXEMPLARS, CONSTANT = 8, 3
#: levels of a tree; the text of deeper elements belongs to the last level, so no page can exhaust the stack
DEPTH = 150
#: children are aligned with those at most this far from the diagonal of the two lists
BAND = 64
#: share of a wrapper's containers that a page must have, with their classes, to fit
FIT = 0.6
#: share of a page's text that an element holds which no class name makes boilerplate
HOLDER = 0.7
#: bytes of a table that is sent to every task, at most; larger ones are joined by a shuffle
SMALL = 32 << 20

# element names (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption""".split())
CONTAINER = frozenset("html body main article section div center table tbody tr td".split())
SKIPPED = frozenset("head nav footer aside form button select option label input textarea menu dialog".split()) | RAW
#: words of class and id that mark boilerplate
HINTS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notices sidebar
    menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond disqus share sharing social related newsletter
    subscribe signup popup modal overlay login search widget pagination pager toolbar""".split())
COMMENTS = frozenset("comment comments respond disqus".split())
#: first and last words of class names that tell a state and not a kind of element
STATES = frozenset("no not non has have with without is hide".split()), frozenset("free enabled disabled open closed active on off".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}}

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_MARK = re.compile(r"\b(class|id|style|hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_DIGITS = re.compile(r"[0-9]+")


@dataclass
class Node:
    tag: str
    mark: str = ""
    hidden: bool = False
    parts: list = field(default_factory=list)  # texts and nodes in page order
    holder: bool = False  # holds the article, whatever its class says

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(page: str) -> Node:
    """A forgiving tree: unclosed paragraphs, items and cells end where a new one or a block starts."""
    root = Node("html")
    stack, at, size = [root], 0, len(page)
    sunk: list[tuple[str, list]] = []  # open elements below the last level, and where their text goes
    while at < size:
        m = _PIECE.search(page, at)
        here = sunk[-1][1] if sunk else stack[-1].parts
        if m is None:
            here.append(page[at:])
            break
        if m.start() > at:
            here.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            below = next((k for k in range(len(sunk) - 1, -1, -1) if sunk[k][0] == tag), None)
            if below is not None:
                del sunk[below:]
                if tag in BLOCK:
                    (sunk[-1][1] if sunk else stack[-1].parts).append(Node("hr"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    sunk.clear()
                    break
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if not sunk and (tag in BLOCK and tag != "hr" or tag == "p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        for k in range(len(stack) - 1, 0, -1) if not sunk else ():
            if tag not in HOLDS or stack[k].tag in HOLDS[tag]:
                break
            if stack[k].tag in CLOSES[tag]:
                del stack[k:]
                break
        mark, hidden = "", False
        if m[3].strip():
            found = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _MARK.finditer(m[3])}
            mark = " ".join(found.get(k, "") for k in ("class", "id")).strip().lower()
            hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        node = Node(tag, mark, hidden)
        here = sunk[-1][1] if sunk else stack[-1].parts
        here.append(node)
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else size
        elif tag in VOID or m[3].rstrip().endswith("/"):
            continue
        elif len(stack) < DEPTH:
            stack.append(node)
        else:
            sunk.append((tag, node.parts if boilerplate(node) else here))
    mark_holders(root)
    return root


def hinted(mark: str) -> set[str]:
    """The words that make an element with these classes boilerplate; class names that tell a state have none."""
    found: set[str] = set()
    for name in mark.split():
        words = _WORD.findall(name)
        if words and words[0] not in STATES[0] and words[-1] not in STATES[1]:
            found |= HINTS.intersection(words)
    return found


def mark_holders(root: Node) -> None:
    """Elements with ``main`` or most of the page's text in them, and the longest article, are boilerplate by no class
    name but that of comments."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag not in SKIPPED and not node.hidden:
            order.append(node)
            stack += node.children
    size: dict[int, int] = {}
    inside: set[int] = set()  # elements that are or hold main
    for node in reversed(order):
        size[id(node)] = sum(len(p.strip()) if isinstance(p, str) else size.get(id(p), 0) for p in node.parts)
        node.holder = node.tag in ("html", "body", "main") or any(id(c) in inside for c in node.children)
        if node.tag == "main" or any(id(c) in inside for c in node.children):
            inside.add(id(node))
    whole = size.get(id(root), 0)
    longest = max((size[id(n)] for n in order if n.tag == "article"), default=0)
    for node in order:
        if node.mark and not node.holder and not COMMENTS & hinted(node.mark):
            node.holder = size[id(node)] > HOLDER * whole or node.tag == "article" and size[id(node)] == longest


def boilerplate(node: Node) -> bool:
    return node.tag in SKIPPED or node.hidden or bool(node.mark and not node.holder and hinted(node.mark))


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, boilerplate left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    def walk(n: Node) -> None:
        for part in n.parts:
            if isinstance(part, str):
                run.append(part)
            elif part.tag in ("br", "td", "th", "img", "wbr") and not part.parts:
                run.append("" if part.tag == "wbr" else " ")
            elif not boilerplate(part):
                block = part.tag in BLOCK
                if block:
                    flush()
                elif part.tag in ("td", "th"):
                    run.append(" ")
                walk(part)
                if block:
                    flush()
    walk(node)
    flush()
    return out


def matching(a: Node, b: Node, weight) -> tuple[float, list]:
    """Simple tree matching: weight of the best order-keeping alignment of two trees, and its node pairs."""
    if a.tag != b.tag:
        return 0.0, []
    own = weight(a, b)
    left, right = a.children, b.children
    # children that no child of the other side can match are left out
    tags = {n.tag for n in left} & {n.tag for n in right}
    left, right = [n for n in left if n.tag in tags], [n for n in right if n.tag in tags]
    if not left or not right:
        return own, [(a, b)]
    n, m = len(left), len(right)
    # row i holds the cells lo[i]..hi[i] of the band around the diagonal; a cell beyond it is the nearest one inside
    middle = [i * m // n for i in range(n + 1)]
    lo, hi = [max(0, j - BAND) for j in middle], [min(m, j + BAND + m // n) for j in middle]
    rows: list[list[tuple]] = [[(0.0, 2)] * (hi[0] - lo[0] + 1)]

    def cell(i: int, j: int) -> float:
        return rows[i][min(max(j, lo[i]), hi[i]) - lo[i]][0]

    for i in range(1, n + 1):
        row: list[tuple] = []
        rows.append(row)
        x = left[i - 1]
        for j in range(lo[i], hi[i] + 1):
            up, side = cell(i - 1, j), row[-1][0] if row else 0.0
            option = (up, 1) if not row or up >= side else (side, 2)
            if j > lo[i - 1] and x.tag == right[j - 1].tag:
                w, pairs = matching(x, right[j - 1], weight)
                through = cell(i - 1, j - 1) + w
                if through > option[0]:
                    option = (through, pairs)
            row.append(option)
    pairs, i, j = [(a, b)], n, m
    while i and j:
        j = min(max(j, lo[i]), hi[i])
        how = rows[i][j - lo[i]][1]
        if isinstance(how, list):
            pairs += how
            i, j = i - 1, j - 1
        elif how == 1:
            i -= 1
        else:
            j -= 1
    return own + rows[-1][-1][0], pairs


def alike(a: Node, b: Node) -> float:
    return 1.0 + (a.mark == b.mark or _DIGITS.sub("", a.mark) == _DIGITS.sub("", b.mark))


def own_text(node: Node) -> str:
    return " ".join(entities.unescape(" ".join(p if isinstance(p, str) else "" for p in node.parts)).split())


def slot(seed: Node, varying: dict[int, float]) -> Node:
    """The container with the varying text: go down while one container child has most of it."""
    def amount(n: Node) -> float:
        return 0.0 if boilerplate(n) or n.tag == "header" else varying.get(id(n), 0.0) + sum(amount(c) for c in n.children)

    node = seed
    while True:
        inner = [(amount(c), c) for c in node.children if c.tag in CONTAINER and not boilerplate(c)]
        whole = amount(node)
        named = [c for _, c in inner if c.tag in ("article", "main") and whole]
        best = max(inner, key=lambda x: x[0], default=(0.0, None))
        if len(named) == 1 and amount(named[0]) > 0:
            node = named[0]
        elif best[1] is not None and best[0] > 0.7 * whole:
            node = best[1]
        else:
            return node


def skeleton(node: Node) -> Node:
    """The containers of a tree, with boilerplate as leaves; texts and what is in an article's paragraphs are left out."""
    inner = [] if boilerplate(node) else [skeleton(c) for c in node.children if c.tag in CONTAINER or boilerplate(c)]
    return Node(node.tag, node.mark, node.hidden, inner, node.holder)


def count(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        total += 1
        stack += stack.pop().children
    return total


def induce(pages: list[str]) -> list[str]:
    """The wrappers of pages of one host, one for each group of pages with like trees."""
    groups: list[tuple[Node, int, list[Node]]] = []
    for tree in map(parse, dict.fromkeys(pages)):
        frame = skeleton(tree)
        size = count(frame)
        # twice the matched containers over all, with their classes
        shares = [matching(frame, other, alike)[0] / (size + n) for other, n, _ in groups]
        best = max(range(len(shares)), key=shares.__getitem__, default=None)
        if best is not None and shares[best] >= FIT:
            groups[best][2].append(tree)
        else:
            groups.append((frame, size, [tree]))
    return [wrapper_of(trees) for _, _, trees in groups]


def wrapper_of(trees: list[Node]) -> str:
    """The wrapper of like pages, as JSON: [tag, mark, is the slot, children], and constant blocks of the slot."""
    trees = sorted(trees, key=lambda t: len(blocks_of(t)))
    seed = trees[len(trees) // 2]
    found = [matching(seed, other, alike)[1] for other in trees]
    texts: dict[int, list[str]] = {}
    for pairs in found:
        for a, b in pairs:
            texts.setdefault(id(a), []).append(own_text(b))
    varying: dict[int, float] = {}

    def note(n: Node) -> None:
        seen = texts.get(id(n), [])
        if len(trees) == 1 or len(set(seen)) > 1 or len(seen) < len(trees):
            varying[id(n)] = float(max(map(len, [own_text(n), *seen])))
        for c in n.children:
            note(c)
    note(seed)
    if not any(varying.values()):  # pages that differ in no text: nothing varies
        return wrapper_of([seed]) if len(trees) > 1 else json.dumps([tree_of(seed, slot(seed, {})), []])
    here = slot(seed, varying)
    seen: dict[str, int] = {}
    different: set[tuple] = set()
    for pairs in found:
        mine = next((b for a, b in pairs if a is here), None)
        blocks = tuple(blocks_of(mine)) if mine is not None else ()
        if blocks and blocks not in different:
            different.add(blocks)
            for block in set(blocks):
                seen[block] = seen.get(block, 0) + 1
    constant = sorted(b for b, n in seen.items() if n == len(different)) if len(different) >= CONSTANT else []
    if len(constant) > 0.5 * max(1, len(blocks_of(here))):
        constant = []
    return json.dumps([tree_of(seed, here), constant])


def tree_of(node: Node, here: Node) -> list:
    """The template around the slot; what is below the slot or below boilerplate is left out."""
    below = [] if node is here or boilerplate(node) else [tree_of(c, here) for c in node.children if c.tag in CONTAINER or boilerplate(c) or c is here]
    return [node.tag, node.mark, node is here, below]


def match_slot(tree: Node, shape: list) -> tuple[float, Node | None]:
    """How well a page fits a wrapper's tree (0 to 1), and the page's slot."""
    slots: list[Node] = []

    def build(x: list) -> Node:
        n = Node(x[0], x[1])
        if x[2]:
            slots.append(n)
        n.parts = [build(c) for c in x[3]]
        return n
    template = build(shape)
    sizes: dict[int, int] = {}

    def weight(a: Node, b: Node) -> float:
        if b is not slots[0]:
            return alike(a, b)
        if id(a) not in sizes:
            sizes[id(a)] = sum(map(len, blocks_of(a)))
        return 3.0 + alike(a, b) + sizes[id(a)] / (1.0 + max(sizes.values()))
    pairs = matching(tree, template, weight)[1]
    found = next((a for a, b in pairs if b is slots[0]), None)
    if found is None or alike(found, slots[0]) < 2:
        return 0.0, None
    return sum(alike(a, b) == 2 for a, b in pairs) / count(template), found


def extract(page: str, wrappers: list[str] | None) -> str:
    tree = parse(page)
    fits = [(*match_slot(tree, shape), constant) for shape, constant in map(json.loads, wrappers or ())]
    fit, found, constant = max(fits, key=lambda x: x[0], default=(0.0, None, []))
    blocks = blocks_of(found) if found is not None and fit >= FIT else []
    kept = [b for b in blocks if b not in constant]
    if not kept:  # no wrapper fits: the page alone
        shape, _ = json.loads(wrapper_of([tree]))
        found = match_slot(tree, shape)[1]
        kept = blocks_of(found) if found is not None else []
    return "\n\n".join(kept)


def host(url):
    """Lower-case host of a URL; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def sent(table: DataFrame, size) -> DataFrame:
    """A written table, to be broadcast if all its rows are SMALL in bytes; if not, joins shuffle."""
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= SMALL else table


def wrappers(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``host`` and its ``wrappers``, from at most EXEMPLARS pages of each host.

    Exemplars are the pages with the smallest hashes: the least of each of 64 buckets first, so a host with a third of
    all pages is reduced before the shuffle; then the least of those.
    """
    rows = pages.select(host(F.col(url_col)).alias("host"), F.xxhash64(id_col, url_col).alias("_h"), F.col(html_col).alias("html"))
    least = rows.groupBy("host", F.pmod("_h", F.lit(64)).alias("_b")).agg(F.min("_h").alias("_h"))
    rank = Window.partitionBy("host").orderBy("_h")
    chosen = materialise(least.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= EXEMPLARS).select("host", "_h"), "exemplars")
    # rows repeated in every column hash alike; each exemplar is taken once
    texts = rows.join(sent(chosen, F.length("host") + 64), ["host", "_h"]).groupBy("host", "_h").agg(F.max("html").alias("html"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = [h for h in group.sort_values("_h")["html"] if isinstance(h, str) and h]
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrappers": [induce(found)]})

    return texts.groupBy("host").applyInPandas(run, "host string, wrappers array<string>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    Blocks of the content slot in page order, joined by two line feeds: character references decoded, white space inside
    a block turned into one space, ends trimmed.  Null and empty pages and pages without content give ''.  A null or
    odd url counts as host ''.  Repeated rows keep a row each; other columns are not read; an empty table gives an
    empty result.  The html is moved only where the wrappers are too many to be sent to every task.
    """
    known = materialise(wrappers(pages, id_col, url_col, html_col), "wrappers")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host(F.col(url_col)).alias("host"))
    size = F.aggregate("wrappers", F.length("host").cast("long") + 64, lambda a, x: a + F.length(x))
    rows = rows.join(sent(known, size), "host", "left").select("page_id", "url", "html", "wrappers")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [extract(h, list(w) if w is not None else None) if isinstance(h, str) and h else "" for h, w in zip(part["html"], part["wrappers"])]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")

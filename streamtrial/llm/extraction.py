"""Main text of web pages by wrapper induction over the pages of a host.

A page is read into a tree of its block elements, in which siblings of one label that follow each other are one node
(records of a list, paragraphs of a text). The commonest tree of a host is its reference; the tree of every other page is
aligned with it by simple tree matching: of two nodes of one label, children are paired in order so that most
nodes match. So each block of text stands in a slot of the host's template, and Spark counts per slot and text the
pages it occurs on. Pages of one title are one voice, so copies of a page don't outvote the others. A text that at least
``SHARE`` of a slot's voices (``VOICES`` at least) have in common is constant, that is template; other slots vary and hold content.

The content is the blocks of the page's main region without constant ones and without what is marked as something else by
its element, role or class (menus, headers, footers, sidebars, adverts, notices, forms, comments). The region is the
``article`` or ``main`` of the page; without one it is the slot that over the whole host holds most varying text, or, on a page
that has little in it, the page's own fullest region.

Only counts per tree, slot and text meet in a host, summed before they are shuffled; a wrapper (reference, region, constant
texts) is one row per host, so a host with a third of all pages is no larger task than another.

Defined cases: null and empty pages have an empty text; pages without a host in their url are a host together; repeated rows count once
for the template and each get their row; hosts of few pages have no constant texts; of equally common trees the least text is
the reference; marks without an end reach to the end of the page; very long pages are worked on whole; other
columns are not read, and those named like results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtrial.llm.common import Scratch, bounded, slices, written
from streamtrial.llm.linking import sized

#: A text is template if this share of a slot's voices has it, and so many voices have it at least.
SHARE, VOICES = 0.8, 5
#: A page that has less than this share of its text in the host's region falls back on its own.
LEAST_SHARE = 0.3

#: Elements by their role in a page.
BLOCKS = frozenset("html body main article section div header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset legend details summary hgroup center dir menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object select audio video canvas noembed noframes xmp".split())
NOT_CONTENT = frozenset("head nav footer aside form button menu dialog fieldset".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOT_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail footer header masthead"
    " cookie cookies consent gdpr notice notices disclaimer newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion share sharing social related recommended"
    " popup modal overlay widget toolbar pager pagination skip hidden".split()
)
_READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: An open element that a start tag closes, and the elements beyond which it isn't looked for.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_BARRIER = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
_NO_PARAGRAPH_BEYOND = BLOCKS - {"p"}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    """A block element of the tree; runs of siblings of one label are one node."""

    label: str
    parent: int
    kids: list[int] = field(default_factory=list)
    main: bool = False  # article or main


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str, int]]  # node, text, characters of it in links; what is marked as no content is left out
    title: str


@lru_cache(20_000)
def _attributes(tag: str, text: str) -> tuple[str, frozenset[str], str, bool]:
    """Label, words of class and id, role, and whether it is hidden."""
    have = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(text)}
    names = sorted(re.findall(r"[a-z]+", have.get("class", "").lower()))
    words = frozenset(w.lower() for k in ("class", "id") for w in _PART.findall(have.get(k, "")))
    return ".".join([tag, *names]), words, have.get("role", "").strip().lower(), "hidden" in have or have.get("aria-hidden") == "true"


def read(text: str | None) -> Page:
    """The tree and the blocks of a page. No markup is an error; what isn't closed ends with the element around it."""
    text = text or ""
    nodes = [Node("page", -1)]
    blocks: list[tuple[int, str, int]] = []
    # open elements: name, node, no content, inside a main region, inside a header of one
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    held: list[str] = []
    linked = links = at = 0
    title = None

    def flush() -> None:
        nonlocal held, linked
        if held:
            said = " ".join("".join(held).split())
            if said:
                blocks.append((stack[-1][1], said, min(linked, len(said))))
        held, linked = [], 0

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            if stack[-1][0] in BLOCKS:
                flush()
            links -= stack[-1][0] == "a"
            stack.pop()

    def heard(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1][2]:
            held.append(said := entities.unescape(piece))
            linked += len(said.strip()) if links else 0

    while at < len(text):
        m = _MARK.search(text, at)
        heard(text[at : m.start()] if m else text[at:])
        if not m:
            break
        at = m.end()
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if found:
                close(found)
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not stack[-1][2]:
                held.append(" ")
            continue
        if tag in RAW or tag == "title":
            stop = re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.I).search(text, at)
            if tag == "title" and title is None:
                title = " ".join(entities.unescape(text[at : stop.start() if stop else len(text)]).split())
            at = stop.end() if stop else len(text)
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _NO_PARAGRAPH_BEYOND:
                    break
            for i in range(len(stack) - 1, 0, -1) if tag in _CLOSES else ():
                if stack[i][0] in _BARRIER[tag]:
                    break
                if stack[i][0] in _CLOSES[tag]:
                    close(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
            flush()
        label, words, role, hidden = _attributes(tag, rest.rstrip("/"))
        _, node, dropped, inside, heading = stack[-1]
        main = tag in ("main", "article") or role in ("main", "article")
        if tag in ("main",) or role == "main":
            dropped = False
        if tag == "header" and inside and not dropped:
            dropped = heading = True  # of a header in the article only headings are content
        elif tag in HEADINGS and heading:
            dropped = False
        elif tag in NOT_CONTENT or tag == "header" or role in NOT_ROLES or hidden or (main and words & _READERS) or (words & NOT_CLASSES and not main and tag not in ("html", "body")):
            dropped, heading = True, False
        if tag in BLOCKS:
            last = nodes[node].kids[-1] if nodes[node].kids else -1
            if last >= 0 and nodes[last].label == label:
                node = last
            else:
                nodes.append(Node(label, node, main=main and not dropped))
                nodes[node].kids.append(len(nodes) - 1)
                node = len(nodes) - 1
        links += tag == "a"
        stack.append((tag, node, dropped, inside or main, heading))
    close(1)
    flush()
    return Page(nodes, blocks, title or "")


def skeleton(page: Page) -> str:
    """The tree as text: a label per line after as many blanks as it is deep. Equal trees have equal texts."""
    out, todo = [], [(0, 0)]
    while todo:
        i, deep = todo.pop()
        out.append(" " * deep + page.nodes[i].label)
        todo += [(k, deep + 1) for k in reversed(page.nodes[i].kids)]
    return "\n".join(out)


def tree(text: str) -> list[Node]:
    """The nodes of a skeleton, in its order."""
    nodes, path = [], []
    for line in text.split("\n"):
        label = line.lstrip(" ")
        deep = len(line) - len(label)
        nodes.append(Node(label, path[deep - 1] if deep else -1))
        if deep:
            nodes[path[deep - 1]].kids.append(len(nodes) - 1)
        path[deep:] = [len(nodes) - 1]
    return nodes


def in_order(nodes: list[Node]) -> list[int]:
    """Nodes from the root, parents before children and children in order."""
    out, todo = [], [0]
    while todo:
        out.append(todo.pop())
        todo += reversed(nodes[out[-1]].kids)
    return out


def _pairs(a: list[int], b: list[int], weight) -> tuple[int, list[tuple[int, int]]]:
    """The greatest sum of weights of children paired in order, and the pairs."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    w = np.array([[weight(i, j) for j in b] for i in a], np.int64).reshape(len(a), len(b))
    for i in range(len(a)):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + w[i]))
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
    return int(table[-1, -1]), out


def aligned(page: list[Node], reference: list[Node]) -> dict[int, int]:
    """Simple tree matching: nodes of the page and the nodes of the reference they stand for."""
    # children before parents, so that no recursion is as deep as the page
    order_a, order_b = in_order(page)[::-1], in_order(reference)[::-1]
    by_label: dict[str, list[int]] = {}
    for j in order_b:
        by_label.setdefault(reference[j].label, []).append(j)
    deep_a, deep_b = _depths(page), _depths(reference)
    weight: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i in order_a:
        for j in by_label.get(page[i].label, ()):
            if deep_a[i] == deep_b[j]:  # pairs are children of pairs
                total, pairs[i, j] = _pairs(page[i].kids, reference[j].kids, lambda x, y: weight.get((x, y), 0)) if page[i].kids and reference[j].kids else (0, [])
                weight[i, j] = total + 1
    out, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        todo += pairs.get((i, j), [])
    return out


def _depths(nodes: list[Node]) -> list[int]:
    out = [0] * len(nodes)
    for i in in_order(nodes)[1:]:
        out[i] = out[nodes[i].parent] + 1
    return out


@dataclass
class Wrapper:
    """What a host's pages have in common."""

    reference: str
    region: int = -1  # node that holds most varying text
    constant: frozenset[tuple[int, int]] = frozenset()  # (node, hash of a text)


def hashes(texts: list[str]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in texts]


def slots_of(page: list[Node], reference: list[Node]) -> dict[int, int]:
    """The slot of each node: the first of its label under the reference node that its parent is aligned with.

    So a run of paragraphs is one slot, whether a list cuts it in two on a page or not; deeper nodes hold to the alignment.
    """
    found = aligned(page, reference)
    for i in in_order(page)[1:]:
        if page[i].parent in found:
            like = next((j for j in reference[found[page[i].parent]].kids if reference[j].label == page[i].label), None)
            if like is not None:
                found.setdefault(i, like)
    return {i: next((k for k in reference[reference[j].parent].kids if reference[k].label == reference[j].label), j) if j else j for i, j in found.items()}


class Aligner:
    """Slots of a page's blocks in a reference; trees seen before are not aligned again."""

    MOST = 1000

    def __init__(self):
        self.known: dict[tuple[str, str], dict[int, int]] = {}

    def __call__(self, page: Page, reference: str) -> dict[int, int]:
        own = skeleton(page)
        place = in_order(page.nodes)
        if (own, reference) not in self.known:
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[own, reference] = slots_of(tree(own), tree(reference))
        found = self.known[own, reference]
        return {i: found[n] for n, i in enumerate(place) if n in found}


def regions(page: Page, blocks: list[tuple[int, str, int]]) -> dict[int, float]:
    """Text (without links) of every region: a block counts for its element's parent, and half for the one above."""
    mass: dict[int, float] = {}
    for node, said, linked in blocks:
        up = max(page.nodes[node].parent, 0) if page.nodes[node].label.partition(".")[0] not in ("div", "section", "td", "article", "main") else node
        mass[up] = mass.get(up, 0) + len(said) - linked
        if (over := page.nodes[up].parent) >= 0:
            mass[over] = mass.get(over, 0) + (len(said) - linked) / 2
    return mass


def _ancestors(page: Page, node: int) -> Iterator[int]:
    while node >= 0:
        yield node
        node = page.nodes[node].parent


def extract(page: Page, wrapper: Wrapper, slots: dict[int, int]) -> str:
    """The blocks of the main region, without constant ones, joined by line feeds."""
    told = hashes([b[1] for b in page.blocks])
    blocks = [b for b, h in zip(page.blocks, told) if (slots.get(b[0], -1), h) not in wrapper.constant]
    inside = [set(_ancestors(page, b[0])) for b in blocks]
    mains = [i for i, n in enumerate(page.nodes) if n.main and any(i in s for s in inside)]
    if mains:
        size = {i: sum(len(b[1]) for b, s in zip(blocks, inside) if i in s) for i in mains}
        # the innermost region that has over half of the text of all main regions
        full = sum(len(b[1]) for b, s in zip(blocks, inside) if s.intersection(mains))
        best = max((i for i in mains if 2 * size[i] > full), default=None, key=lambda i: (len(list(_ancestors(page, i))), size[i]))
        wanted = {best} if best is not None else set(mains)
    else:
        mass = regions(page, blocks)
        own = max(mass, key=lambda i: (mass[i], -i), default=0)
        host = next((i for i, slot in slots.items() if slot == wrapper.region), None)
        wanted = {host if host is not None and mass.get(host, 0) > LEAST_SHARE * mass.get(own, 0) else own}
    return "\n".join(b[1] for b, s in zip(blocks, inside) if s & wanted)


_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (empty without one)."""
    host = F.translate(F.coalesce(F.regexp_extract("url", "(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_ASCII)
    return pages.select("page_id", "url", "html", host.alias("host"))


def trees(pages: DataFrame) -> DataFrame:
    """host, reference: the commonest tree of each host."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            own = [skeleton(read(t)) for t in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(own, pa.string())], names=["host", "tree"])

    counts = pages.select("host", "html").mapInArrow(run, "host string, tree string").groupBy("host", "tree").count()
    return counts.groupBy("host").agg(F.max_by("tree", F.struct("count", F.col("tree"))).alias("reference"))


VOTES = "host string, node int, said long, title long, chars double, region int"


def votes(pages: DataFrame) -> DataFrame:
    """A row per block: its slot, hash of its text and of the page's title, and the text it adds to which region of the reference."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        for part in slices(batches, "html"):
            out = []
            for host, text, reference in zip(*(part.column(k).to_pylist() for k in ("host", "html", "reference"))):
                page = read(text)
                slots = align(page, reference)
                voice = hashes([page.title or (page.blocks[0][1] if page.blocks else "")])[0]
                said = hashes([b[1] for b in page.blocks])
                for block, h in zip(page.blocks, said):
                    if block[0] in slots:
                        for region, mass in regions(page, [block]).items():
                            out.append((host, slots[block[0]], h, voice, mass, slots.get(region, -1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=[f.split()[0] for f in VOTES.split(", ")])

    return pages.select("host", "html", "reference").mapInArrow(run, VOTES)


def wrappers(pages: DataFrame, references: DataFrame, keep) -> DataFrame:
    """host, reference, region, constant: one row per host."""
    said = keep(votes(pages.join(sized(references, F.octet_length("reference") + 64), "host")).groupBy("host", "node", "said", "title", "region").agg(F.sum("chars").alias("chars")))
    voices = said.select("host", "node", "title").distinct().groupBy("host", "node").agg(F.count("*").alias("voices"))
    texts = said.select("host", "node", "said", "title").distinct().groupBy("host", "node", "said").agg(F.count("*").alias("votes")).where(F.col("votes") >= VOICES)
    constant = keep(texts.join(sized(keep(voices)), ["host", "node"]).where(F.col("votes") >= SHARE * F.col("voices")).select("host", "node", "said"))
    varying = said.join(sized(constant.withColumn("is_constant", F.lit(True))), ["host", "node", "said"], "left").where("is_constant is null and region >= 0")
    mass = varying.groupBy("host", "region").agg(F.sum("chars").alias("chars"))
    region = mass.groupBy("host").agg(F.max_by("region", F.struct("chars", -F.col("region"))).alias("region"))
    # no more than a page's blocks over SHARE are constant in a host, as each voice has one vote per slot and text
    held = constant.groupBy("host").agg(F.collect_list(F.struct("node", "said")).alias("constant"))
    return references.join(region, "host", "left").join(held, "host", "left").select("host", "reference", F.coalesce("region", F.lit(-1)).alias("region"), "constant")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = bounded(pages.sparkSession)
    rows = with_host(pages)
    with Scratch(spark) as keep:
        references = keep(trees(rows))
        rule = written(wrappers(rows, references, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, known = Aligner(), {}
        for part in slices(batches, "html"):
            texts = []
            for text, host, reference, region, constant in zip(*(part.column(k).to_pylist() for k in ("html", "host", "reference", "region", "constant"))):
                if host not in known:
                    known = {host: Wrapper(reference, region, frozenset((c["node"], c["said"]) for c in constant or ()))}
                page = read(text)
                texts.append(extract(page, known[host], align(page, reference)))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    size = F.octet_length("reference") + 12 * F.greatest(F.size("constant"), F.lit(0)) + 64
    both = rows.join(sized(rule, size), "host").select("page_id", "url", "html", "host", "reference", "region", "constant")
    return both.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")

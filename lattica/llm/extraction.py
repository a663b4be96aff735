"""Main text of web pages by wrapper induction.

All different pages of a host are parsed, and their trees are aligned with simple tree matching, some at a time: siblings of one kind are
folded into one node, then children are matched in order so that most nodes correspond. What stands at the same node with the same words
on nearly all pages is template; nodes whose words vary are slots. The wrapper of a host holds its template words, the part of the tree
where its slots have most text, and the slots that hold links alone. Every page is then read with the wrapper of its host: what is left
of that part without template words and link slots, and without elements inside of it that name themselves something else, is the text.

Names, roles and tags are a prior only: an article or main element makes text count ``PRIOR`` times, an element named like a sidebar makes
it count that many times less, and where a host's text stands in such an element all the same, it is the content. A page without a wrapper
(a host of fewer than ``FEWEST`` different pages, no URL, or a layout of its own) is decided in the same way by itself, its marks obeyed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.dom import BLOCK, Element, parse
from lattica.llm.shared import materialize, table

#: Pages of a host that are aligned together, and the least number of different pages for a wrapper.
ALIGNED = 16
FEWEST = 3
#: Share of the pages on which template words stand.
CONSTANT = 0.8
#: How many times the text of article and main elements counts, and how much less that of marked ones; share of the weighted text that a part has to hold.
PRIOR = 8.0
MOST = 0.7
#: Share of link characters from which a slot is a menu.
LINKS = 0.9

# Never text, or never part of an article.
_NEVER = {
    "script", "style", "noscript", "template", "nav", "aside", "footer", "button", "select", "textarea", "input", "iframe", "svg", "canvas", "object", "head", "title", "dialog", "menu", "xmp",
    "noembed", "noframes", "audio", "video", "option", "datalist",
}
_FORM = {"form", "label", "fieldset"}
# Names of what is no article, and words that may stand beside them in a name; a name with any other word tells nothing.
_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar navbar nav navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr "
    "notice notices notification alert modal popup overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist commentform "
    "reply replies respond disqus discussion pagination pager widget widgets toolbar skip paywall disclaimer copyright legal tracking".split()
)
_BESIDE = set(
    "left right top bottom upper lower first last box list item items area block container wrapper wrap inner outer section panel bar button buttons link links icon icons row col column content group "
    "text title heading body form main page site blog post entry article story user reader readers the and of by for my new global primary secondary small large mobile desktop inline sticky fixed hidden".split()
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PARTS = {"p", "li", "ul", "ol", "dl", "table", "tbody", "tr", "td", "th", "blockquote", "pre"}


def _named_other(value: str) -> bool:
    """Whether one of the names in a class or id says something else than content, all its words taken together."""
    for name in value.split():
        pieces = {x.lower() for x in _PIECE.findall(name)}
        if pieces & _NAMES and all(x in _NAMES or x in _BESIDE or len(x) == 1 for x in pieces):
            return True
    return False


def standing(e: Element, path: tuple[str, ...] = ()) -> bool | None:
    """None for an element that is never content, True for one marked as something else by its tag, role or names, else False.

    Names and roles say nothing of an element that holds an article or a main heading, unless it stands in an article itself.
    """
    if e.tag in _NEVER:
        return None
    if e.attributes.strip(" /"):
        if e.has("hidden") or e.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", e.get("style")):
            return None
        if e.tag not in ("html", "body", "main") and (set(e.get("role").lower().split()) & _ROLES or _named_other(e.get("class", "id"))):
            return bool(_within(path, "article")) or not any(x.tag in ("article", "main", "h1") for x in e.walk() if x is not e)
    if e.tag == "header":
        below = {x.tag for x in e.walk()}
        return not below & {"h1", "h2"} or bool(below & {"nav", "form", "ul"})
    if e.tag in _FORM:
        below = Counter(x.tag for x in e.walk())
        return e.tag != "form" or below["p"] < 3 and not below.keys() & {"article", "main", "h1", "h2"}
    return False


def kind(e: Element, marked: bool = False) -> str:
    """Tag and class words without digits, with ! if marked: what folds and matches."""
    names = sorted({x.lower() for x in _PIECE.findall(e.get("class"))}) if "class" in e.attributes else []
    return ".".join([e.tag, *names]) + "!" * marked


Block = tuple[tuple[str, ...], str, int]


def blocks(root: Element) -> Iterator[Block]:
    """Path, text with single spaces and number of link characters of each block that may be content, in page order."""
    words: list[str] = []
    links = 0

    def taken() -> tuple[str, int]:
        nonlocal words, links
        text, n = " ".join("".join(words).split()), links
        words, links = [], 0
        return text, min(n, len(text))

    stack: list = [(root, (), 0)]
    while stack:
        item, where, linked = stack.pop()
        if item is None:  # the end of a block
            text, n = taken()
            if text:
                yield where, text, n
        elif isinstance(item, str):
            words.append(item)
            links += len(item.strip()) * linked
        else:
            marked = standing(item, where) if item is not root else False
            if marked is None:
                continue
            inner = where
            if item is not root and (marked or item.tag in BLOCK):
                text, n = taken()
                if text:
                    yield where, text, n
                inner = (*where, kind(item, marked))
                stack.append((None, inner, 0))
            linked = linked or item.tag == "a"
            stack += [(c, inner, linked) for c in reversed(item.children)]
    text, n = taken()
    if text:
        yield (), text, n


class Node:
    """A node of a template: kind, folded children, and of each of its own texts the pages, the plain and the link characters."""

    __slots__ = ("children", "kind", "texts")

    def __init__(self, name: str):
        self.kind, self.children, self.texts = name, [], {}

    def add(self, text: str, pages: int, plain: int, linked: int) -> None:
        old = self.texts.get(text, (0, 0, 0))
        self.texts[text] = (old[0] + pages, old[1] + plain, old[2] + linked)


def folded(html: str) -> Node:
    """The blocks of a page as a tree in which siblings of one kind are one node; a text that a node has several times counts once."""
    root = Node("")
    at_path: dict[tuple[str, ...], Node] = {(): root}
    for path, text, links in blocks(parse(html)):
        new = len(path)  # from which place on the path has no node yet
        while path[:new] not in at_path:
            new -= 1
        for k in range(new, len(path)):
            at_path[path[: k + 1]] = child = Node(path[k])
            at_path[path[:k]].children.append(child)
        at_path[path].texts[text] = (1, len(text) - links, links)
    return root


Matching = tuple[int, list]


def matching(a: Node, b: Node) -> Matching:
    """Simple tree matching of two nodes of one kind: how many nodes correspond at most, in order and under corresponding parents, and the pairs of children with their own matchings.

    Children of different kinds never correspond, and folding leaves few of one kind, so the best pairs are the heaviest chain that
    rises on both sides. It is found with a tree of best weights, in n log n.
    """
    where: dict[str, list[int]] = {}
    for j, q in enumerate(b.children):
        where.setdefault(q.kind, []).append(j)
    size = len(b.children) + 1
    heaviest: list[tuple[int, tuple | None]] = [(0, None)] * (size + 1)

    for p in a.children:
        found = []
        for j in where.get(p.kind, ()):
            inner, at, best = matching(p, b.children[j]), j, (0, None)
            while at > 0:  # the heaviest chain that ends before j
                best = max(best, heaviest[at], key=lambda x: x[0])
                at &= at - 1
            found.append((j, best[0] + inner[0], ((p, b.children[j], inner), best[1])))
        for j, weight, chain in found:
            at = j + 1
            while at <= size:
                if heaviest[at][0] < weight:
                    heaviest[at] = (weight, chain)
                at += at & -at
    total, chain, at = 0, None, size
    while at > 0:
        if heaviest[at][0] > total:
            total, chain = heaviest[at]
        at &= at - 1
    pairs = []
    while chain:
        pairs.append(chain[0])
        chain = chain[1]
    return total + 1, pairs[::-1]


def merge(template: Node, page: Node, found: Matching | None = None) -> None:
    """Align a page with the template and add it: matched nodes count it, others are put in behind."""
    _, pairs = found or matching(template, page)
    for text, counts in page.texts.items():
        template.add(text, *counts)
    for p, q, inner in pairs:
        merge(p, q, inner)
    done = {id(q) for _, q, _ in pairs}
    template.children += [q for q in page.children if id(q) not in done]


def tallied(trees: list[Node]) -> Iterator[tuple[str, str, int, int, int]]:
    """Of aligned trees: path, mark of a text, on how many pages it stands there, and its plain and link characters on them."""
    template = trees[0]
    for tree in trees[1:]:
        merge(template, tree)
    stack: list[tuple[Node, tuple[str, ...]]] = [(template, ())]
    while stack:
        node, path = stack.pop()
        name = "\n".join(path)
        yield from ((name, mark(path, text), *counts) for text, counts in node.texts.items())
        stack += [(c, (*path, c.kind)) for c in node.children]


def mark(path: tuple[str, ...], text: str) -> str:
    """128 bits that stand for a text at a node."""
    return hashlib.md5("\n".join((*path, text)).encode("utf-8", "surrogatepass")).hexdigest()


def _within(path: tuple[str, ...], part: str) -> int | None:
    """How many kinds of a path lead into the first article (or main) element that no mark stands before or on."""
    for k, name in enumerate(path):
        if name.endswith("!"):
            return None
        if name == part or name.startswith(part + "."):
            return k + 1
    return None


def decided(slots: dict[str, tuple[int, int]], constant: list[str] = (), marked: float = 1 / PRIOR) -> dict:
    """The wrapper of slots (path to plain and link characters): marks of template words, the part or path that holds the content, and link slots.

    Text under marks weighs ``marked``. Content are all article elements, or else all main elements, if they hold ``MOST`` of the weight;
    otherwise it is what stands below the deepest path that does.
    """
    weights: dict[tuple[str, ...], float] = {}
    parts = dict.fromkeys(("article", "main"), 0.0)
    for path, (plain, linked) in slots.items():
        kinds = tuple(path.split("\n")) if path else ()
        inside = [part for part in parts if _within(kinds, part)]
        weights[kinds] = (plain + linked * bool(inside)) * (PRIOR if inside else marked if any(k.endswith("!") for k in kinds) else 1.0)
        for part in inside:
            parts[part] += weights[kinds]
    total = sum(weights.values())
    out = {"constant": sorted(constant), "part": "", "content": [], "links": sorted(p for p, (plain, linked) in slots.items() if linked and linked >= LINKS * (plain + linked))}
    if not total:
        return out | {"part": None}
    for part, weight in parts.items():
        if weight >= MOST * total:
            return out | {"part": part}
    below: Counter = Counter()
    for kinds, weight in weights.items():
        for k in range(len(kinds) + 1):
            below[kinds[:k]] += weight
    children: dict[tuple, list[tuple]] = {}
    for path in sorted(below):
        if path:
            children.setdefault(path[:-1], []).append(path)
    at: tuple[str, ...] = ()
    while at in children and (child := max(children[at], key=below.__getitem__)) and below[child] >= MOST * below[at] and child[-1].split(".")[0] not in _PARTS:
        at = child
    return out | {"content": list(at)}


def induced(pages: list[str]) -> dict:
    """The wrapper of one host's pages; empty for few pages, and where nothing varies: copies of one page do not tell what is template."""
    trees = [folded(h) for h in dict.fromkeys(pages)]
    if len(trees) < FEWEST:
        return {}
    least = max(FEWEST, CONSTANT * len(trees))
    constant, slots = [], {}
    for path, at, n, plain, linked in tallied(trees):
        if n >= least:
            constant.append(at)
        else:
            old = slots.get(path, (0, 0))
            slots[path] = (old[0] + plain, old[1] + linked)
    return decided(slots, constant) if slots else {}


def chosen(found: list[Block], wrapper: dict) -> list[str]:
    """The texts of the blocks that a wrapper takes for content."""
    constant, links, content, part = set(wrapper["constant"]), set(wrapper["links"]), tuple(wrapper["content"]), wrapper["part"]
    out = []
    for path, text, _ in found if part is not None else ():
        inside = _within(path, part) if part else len(content) if path[: len(content)] == content else None
        if inside is None or any(k.endswith("!") for k in path[inside:]) or part != "article" and "\n".join(path) in links:
            continue
        if not constant or mark(path, text) not in constant:
            out.append(text)
    return out


def main_text(html: str, wrapper: dict | None = None) -> str:
    """The article of a page, its blocks joined by spaces. Without a wrapper, or where it finds nothing, the page's own tree and marks decide."""
    found = list(blocks(parse(html)))
    if wrapper:
        if texts := chosen(found, wrapper):
            return " ".join(texts)
        constant = set(wrapper["constant"])
        found = [x for x in found if mark(x[0], x[1]) not in constant]
    slots: dict[str, tuple[int, int]] = {}
    for path, text, linked in found:
        old = slots.get("\n".join(path), (0, 0))
        slots["\n".join(path)] = (old[0] + len(text) - linked, old[1] + linked)
    return " ".join(chosen(found, decided(slots, marked=0.0)))


def host(url: Column) -> Column:
    """The host of a URL, lower case, without user and port; '' for null or none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_TALLY = {"host": "string", "path": "string", "mark": "string", "n": "long", "plain": "long", "linked": "long"}


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of the hosts where something varies, from the host and html of ``pages``; pages of host '' belong to none.

    All different pages of a host count. They are aligned where they are read, ``ALIGNED`` at a time, and what is counted of each
    alignment is added up by node and text, so that no host's pages come together in one task.
    """
    hashed = pages.filter("host <> ''").select("host", "html").withColumn("hash", F.xxhash64("html"))
    sizes = hashed.groupBy("host", "hash").count()
    again = materialize(sizes.filter("count > 1").select("host", "hash"), "repeated-pages")
    least = sizes.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= FEWEST)
    least = materialize(least.select("host", F.greatest(F.lit(float(FEWEST)), CONSTANT * F.col("pages")).alias("least")), "hosts")
    once = hashed.join(again, ["host", "hash"], "left_anti").unionByName(hashed.join(again, ["host", "hash"], "left_semi").dropDuplicates(["host", "hash"]))
    types = {"string": pa.string(), "long": pa.int64()}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, by, out = batch.slice(at, 1000), {}, []
                for k, name in enumerate(part.column("host").to_pylist()):
                    by.setdefault(name, []).append(k)
                for name, rows in by.items():
                    for k in range(0, len(rows), ALIGNED):
                        out += [(name, *x) for x in tallied([folded(part.column("html")[r].as_py()) for r in rows[k : k + ALIGNED]])]
                columns = list(zip(*out, strict=True)) or [()] * len(_TALLY)
                yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, _TALLY.values(), strict=True)], names=list(_TALLY))

    found = once.select("host", "html").mapInArrow(tally, ", ".join(f"{k} {v}" for k, v in _TALLY.items())).groupBy("host", "path", "mark").agg(*(F.sum(c).alias(c) for c in ("n", "plain", "linked")))
    found = materialize(found.join(least, "host"), "tally")
    slots = found.filter("n < least").groupBy("host", "path").agg(F.sum("plain").alias("plain"), F.sum("linked").alias("linked"))
    varying = slots.select("host").distinct()
    constant = found.filter("n >= least").join(varying, "host", "left_semi").select("host", "path", "mark", F.lit(0).cast("long").alias("plain"), F.lit(0).cast("long").alias("linked"))
    known = constant.unionByName(slots.withColumn("mark", F.lit(None).cast("string")))

    def decide(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()  # nodes and template words of one host, however many pages it has
        wrapper = decided({r["path"]: (r["plain"], r["linked"]) for r in rows if r["mark"] is None}, [r["mark"] for r in rows if r["mark"] is not None])
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})

    return known.groupBy("host").applyInArrow(decide, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null and empty html give an empty text.

    Hosts with fewer than three different pages, and pages without a url, are read by their own marks alone. Rows that repeat
    give rows that repeat; other columns, whatever their names, are ignored. Wrappers are broadcast while they are small; beyond
    that the pages are shuffled once by host, where adaptive execution splits the hosts that are too large for a task.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), host(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = materialize(wrappers(rows), "wrappers")
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for html, wrapper in zip(part.column("html"), part.column("wrapper").to_pylist(), strict=True):
                    if wrapper is not None and wrapper not in known:
                        known = known if len(known) < 5000 else {}
                        known[wrapper] = json.loads(wrapper)
                    out.append(main_text(html.as_py(), known[wrapper] if wrapper else None))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = f"page_id {schema['page_id'].dataType.simpleString()}, url {schema['url'].dataType.simpleString()}, text string, n_chars long"
    return rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, kinds)


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""HTML extraction by wrapper induction over the pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.work import saved, table

CONSTANT_PAGES = 8     # pages of a host from which a node's text can count as constant
CONSTANT_SHARE = 0.9   # share of those pages that must have the same text
SIDE_SHARE = 0.5       # a marked subtree with so much of the varying text is no side element
ONE_SHARE = 0.9        # share of the text of like siblings with which one of them is the article alone
ROOT_SHARE = 0.6       # a subtree with so much of the varying text is descended into
LINK_SHARE = 0.8       # a list with so much of its text in links is a menu
HOSTS_AT_ONCE = 2000   # wrappers that a task holds before it sends them on
DEPTH = 100            # blocks nested deeper are laid side by side at this depth, in page order
SALTS = 64             # partial wrappers of one host are merged in so many groups first

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|(?P<text>[^<]+|<)", re.I | re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: what is no text of a page, for Spark's regular expressions
NO_TEXT = (r"(?is)<!--.*?-->|<(script|style|noscript|template|textarea|iframe|svg|select|title)\b.*?</\1\s*>"
           r"|<[a-z/!?][^>]*>|\s+|&nbsp;")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: an open element that the start of another ends
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div".split())
#: tags and words of class, id or role that mark what isn't the article
SIDE_TAGS = frozenset("head nav footer aside form button menu dialog".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus "
    "respond replies reply discussion complementary contentinfo search toolbar".split())
#: names that sites compose of such words: commentlist, comment-form, adbox, advertising, sidebar1
SIDE_PIECE = re.compile(r"comment(s|er|list|slist|form|area|box|thread|wrap|wrapper|section)*|ads?(box|slot|unit|wrap|wrapper|container|block|zone|space|frame)s?"
                        r"|adverti[sz]\w*|sponsor\w*|sidebar\w*|cookie\w*|breadcrumb\w*|newsletter\w*|disqus\w*")
MAIN_TAGS = frozenset({"article", "main"})
NEVER_SIDE = MAIN_TAGS | {"html", "body"}
SIDE_IDS = frozenset("comments respond sidebar footer nav menu masthead".split())
LISTS = frozenset("ul ol div section table".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th dt dd".split())


@dataclass
class Node:
    """A block element; ``parts`` holds its text runs and child blocks in page order."""

    tag: str
    label: str
    side: bool
    parts: list = field(default_factory=list)
    links: int = 0


def _label(tag: str, rest: str) -> tuple[str, bool]:
    if not rest.strip():
        return tag, tag in SIDE_TAGS
    words: list[str] = []
    hints: list[str] = []
    for m in _NAMED.finditer(rest):
        found = (m[2] or m[3] or m[4] or "").lower().split()
        words += found
        # generators give headings and sections ids made of their text: such an id is no mark
        if m[1].lower() != "id" or (tag not in LEAVES and (tag != "section" or set(found) <= SIDE_IDS)):
            hints += found
    words = sorted({re.sub(r"\d+", "0", w) for w in words})
    pieces = {x for w in hints for x in re.split(r"[^a-z]+", w)}
    side = bool(pieces & SIDE_WORDS) or any(SIDE_PIECE.fullmatch(x) for x in pieces)
    return ".".join([tag, *words]), tag in SIDE_TAGS or (tag not in NEVER_SIDE and side)


def parse(source: str) -> Node:
    """The tree of block elements of a page. Unclosed elements end as HTML lets them; character
    references are decoded; comments, scripts and styles are gone. Trees are at most ``DEPTH`` + 1 blocks
    deep, so what walks them may recurse: deeper blocks become neighbours, their text and its order stay."""
    root = Node("", "", False)
    stack, blocks, links = [("", root)], [root], [0]

    def close(upto: int) -> None:
        while len(stack) > upto:
            tag, node = stack.pop()
            links[0] -= tag == "a"
            if node is not None:
                blocks.pop()
                if len(blocks) > DEPTH + 1:  # what follows a block laid beside it goes to a node after both
                    blocks[-1] = Node(blocks[-1].tag, blocks[-1].label, blocks[-1].side)
                    blocks[DEPTH].parts.append(blocks[-1])

    for m in _TOKEN.finditer(source):
        if m["text"] is not None:
            text = entities.unescape(m["text"])
            blocks[-1].parts.append(text)
            if links[0]:
                blocks[-1].links += len("".join(text.split()))
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            inline = tag in INLINE
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if inline and stack[k][1] is not None:
                    break
            continue
        if tag == "br" or tag == "hr":
            blocks[-1].parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            if not m["rest"].endswith("/"):
                stack.append((tag, None))
                links[0] += tag == "a"
            continue
        ends = ENDS.get(tag, set()) | {"p"}
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ends:
                close(k)
                break
            if stack[k][0] in SCOPE:
                break
        label, side = _label(tag, m["rest"])
        node = Node(tag, label, side or (len(blocks) > DEPTH + 1 and blocks[-1].side))
        blocks[min(len(blocks) - 1, DEPTH)].parts.append(node)
        stack.append((tag, node))
        blocks.append(node)
    return root


# --- templates --------------------------------------------------------------------------
# A template node is a dict: l label, t tag, x side, n pages, h hash of its own text, s pages with
# that text (majority count), c characters of its own text, k those in links, r whether it stands
# for several siblings, d its children, z (at the root) whether unmark() is done.

def _own(node: Node) -> str:
    return " ".join("".join(p for p in node.parts if isinstance(p, str)).split())


def _grouped(node: Node) -> list[list[Node]]:
    """Child blocks; neighbours with one label are one group."""
    out: list[list[Node]] = []
    for p in node.parts:
        if isinstance(p, Node):
            if out and out[-1][0].label == p.label:
                out[-1].append(p)
            else:
                out.append([p])
    return out


def template(node: Node) -> dict:
    """The template of a single page."""
    own = _own(node)
    t = {"l": node.label, "t": node.tag, "x": node.side, "n": 1, "h": zlib.crc32(own.encode("utf-8", "replace")), "s": 1,
         "c": len(own), "k": node.links, "r": False, "d": []}
    for group in _grouped(node):
        made = template(group[0])
        for other in group[1:]:
            made = merge(made, template(other))
        made["n"], made["r"] = 1, len(group) > 1
        made["s"] = min(1, made["s"])
        t["d"].append(made)
    return t


def matching(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the pairs, in order, whose labels are equal and
    whose matched nodes are most."""
    if [x["l"] for x in a] == [x["l"] for x in b] and len({x["l"] for x in a}) == len(a):
        return [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    weight = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            w = 0
            if x["l"] == y["l"]:
                w = weight[i, j] = matched(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return pairs[::-1]


def matched(x: dict, y: dict) -> int:
    """Nodes of the largest common top-down, order-keeping part of two trees with one label."""
    return 1 + sum(matched(x["d"][i], y["d"][j]) for i, j in matching(x["d"], y["d"]))


def merge(a: dict, b: dict) -> dict:
    """The template of the pages of both; the text is the one that more of them have."""
    if a["h"] == b["h"]:
        h, s = a["h"], a["s"] + b["s"]
    else:
        h, s = (a["h"], a["s"] - b["s"]) if a["s"] >= b["s"] else (b["h"], b["s"] - a["s"])
    out = {**a, "n": a["n"] + b["n"], "h": h, "s": s, "c": a["c"] + b["c"], "k": a["k"] + b["k"], "r": a["r"] or b["r"], "d": []}
    i = j = 0
    for x, y in [*matching(a["d"], b["d"]), (len(a["d"]), len(b["d"]))]:
        out["d"] += a["d"][i:x] + b["d"][j:y]
        if x < len(a["d"]):
            out["d"].append(merge(a["d"][x], b["d"][y]))
        i, j = x + 1, y + 1
    return out


def constant(t: dict) -> bool:
    """Template, not slot: the same text in nearly all of enough pages."""
    return not t["r"] and not t["d"] and t["c"] > 0 and t["n"] >= CONSTANT_PAGES and t["s"] >= CONSTANT_SHARE * t["n"]


def _mass(t: dict) -> float:
    """Characters in the varying slots of a subtree that no mark excludes."""
    return 0.0 if t["x"] else _inside(t)


def _inside(t: dict) -> float:
    """``_mass`` without regard to a mark of the subtree's root itself."""
    return _own_mass(t) + sum(_mass(d) for d in t["d"])


def _own_mass(t: dict) -> float:
    return 0 if constant(t) else max(0, t["c"] - t["k"])


def unmark(t: dict) -> dict:
    """The template without the marks of subtrees that hold most of all varying text in elements
    that are not marked themselves, such as a form or a ``with-sidebar`` around the whole page."""
    if t.get("z"):  # done before
        return t

    def whole(x: dict) -> float:
        return _own_mass(x) + sum(whole(d) for d in x["d"])

    least = SIDE_SHARE * whole(t)

    def look(x: dict) -> float:
        inside = _own_mass(x) + sum(look(d) for d in x["d"])
        if x["x"] and inside > least:
            x["x"] = False
        return 0.0 if x["x"] else inside

    look(t)
    t["z"] = True
    return t


def content_path(t: dict) -> list[int]:
    """Child positions from the root to the subtree that holds the article: the marked main element
    with most varying text, or else down from the root while one child has most of it."""
    found: list[tuple[float, int, list[int]]] = []

    def look(x: dict, path: list[int]) -> None:
        if x["x"]:
            return
        if x["t"] in MAIN_TAGS or "main" in x["l"].split(".")[1:]:
            found.append((_mass(x), -len(path), path))
        for i, d in enumerate(x["d"]):
            look(d, [*path, i])

    look(t, [])
    if found and max(found)[0] > 0:
        top = max(found)
        # a main element inside another holds nearly the same text: take the inner article
        inner = [f for f in found if f[2][:len(top[2])] == top[2] and f[0] >= 0.95 * top[0]]
        return max(inner, key=lambda f: len(f[2]))[2]
    path: list[int] = []
    whole = _mass(t)  # of the page: shares of it, or many steps would lose much in all
    while True:
        best = max(range(len(t["d"])), key=lambda i: _mass(t["d"][i]), default=None)
        if best is None or whole <= 0 or _mass(t["d"][best]) < ROOT_SHARE * whole or t["d"][best]["t"] in LEAVES:
            return path
        path.append(best)
        t = t["d"][best]


def _blocks(node: Node, t: dict | None, strict: bool, out: list[str]) -> None:
    """Text blocks of a subtree in page order, without side elements, and without constants and menus that
    stand before or after all of its varying blocks."""
    placed: dict[int, dict] = {}
    if t is not None:
        groups = _grouped(node)
        shapes = [template(g[0]) for g in groups] if len(groups) > 1 else [{"l": g[0].label, "d": []} for g in groups]
        for i, j in matching(shapes, t["d"]):
            for n in groups[i]:
                placed[id(n)] = t["d"][j]
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    varying: list[int] | None = None

    def between(k: int) -> bool:
        nonlocal varying
        if varying is None:
            varying = [i for i, p in enumerate(node.parts) if isinstance(p, Node) and _varies(p, placed.get(id(p)))]
        return bool(varying) and varying[0] < k < varying[-1]

    for k, p in enumerate(node.parts):
        if isinstance(p, str):
            run.append(p)
            continue
        flush()
        below = placed.get(id(p))
        if (p.side if below is None else below["x"]) or (strict and p.tag == "header"):
            continue
        if below is not None and constant(below) and not (p.tag in LEAVES and between(k)):
            continue
        if below is not None and p.tag in LISTS and _links(below) >= LINK_SHARE * max(1, _chars(below)) and _links(below) and not between(k):
            continue
        _blocks(p, below, strict, out)
    flush()


def _varies(p: Node, t: dict | None) -> bool:
    """A block of the article itself: what stands between two of them belongs to it, as a heading that all
    articles of a host share or a list of links."""
    if t is None:
        return not p.side and p.tag in LEAVES
    return not t["x"] and not constant(t) and _mass(t) > 0


def _chars(t: dict) -> int:
    return t["c"] + sum(_chars(d) for d in t["d"])


def _links(t: dict) -> int:
    return t["k"] + sum(_links(d) for d in t["d"])


def _has_leaf(t: dict) -> bool:
    return any(d["t"] in LEAVES or _has_leaf(d) for d in t["d"])


def _nearly_all(like: list[Node]) -> Node | None:
    """The one of several like siblings with nearly all of their text; null if there is none. Those without
    any block of text, such as a banner's, don't count beside others that have one."""
    if len(like) == 1:
        return like[0]
    made = [template(n) for n in like]
    mass = [_inside(t) if _has_leaf(t) else 0.0 for t in made]
    if not any(mass):
        mass = [_inside(t) for t in made]
    k = max(range(len(like)), key=mass.__getitem__)
    return like[k] if mass[k] >= ONE_SHARE * sum(mass) else None


def extract(source: str | None, wrapper: dict | None) -> str:
    """The article of a page under the wrapper of its host (or under the page's own template)."""
    node = parse(source or "")
    if wrapper is not None:
        at, t = node, unmark(wrapper)
        for step in content_path(wrapper):
            groups = _grouped(at)
            to = {j: i for i, j in matching([template(g[0]) for g in groups], t["d"])}
            if step not in to:
                below = False
                break
            # of several like siblings the one with nearly all text is the article, else they all are
            best = _nearly_all(groups[to[step]])
            if best is None:
                below = True
                break
            at, t = best, t["d"][step]
        else:
            below = True
        if below:
            out: list[str] = []
            _blocks(at, t, at.tag in ("", "html", "body"), out)
            if out:  # else a host of copies, in which all is constant
                return "\n".join(out)
    own = t = unmark(template(node))
    for step in content_path(own):
        best = _nearly_all(_grouped(node)[step])
        if best is None:
            break
        node, t = best, t["d"][step]
    out: list[str] = []
    _blocks(node, t, node.tag in ("", "html", "body"), out)
    return "\n".join(out)


# --- Spark ------------------------------------------------------------------------------

def host(url):
    """Lower-case host of a URL column without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Rows ``host, html``: one page for each host and hash of the text (tags, scripts and white
    space aside), the least of its copies; each task sends at most one row of a host's copies."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), NO_TEXT, "")
    return (pages.select(host(F.col("url")).alias("host"), F.xxhash64(text).alias("th"), "html")
            .groupBy("host", "th").agg(F.min("html").alias("html")).select("host", "html"))


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows ``host, wrapper`` (JSON): the distinct pages of a host aligned into one template, so
    that many copies of one page don't make its text count as constant.

    Each task folds the pages it reads into one partial template for each host, so a host with a
    third of all pages sends one small row per task; partial templates are merged in ``SALTS``
    groups and then per host."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([json.dumps(t) for t in held.values()], pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for h, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                t = template(parse(source.as_py() or ""))
                held[h] = merge(held[h], t) if h in held else t
                if len(held) >= HOSTS_AT_ONCE:
                    yield send()
                    held.clear()
        if held:
            yield send()

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        made: dict | None = None
        for w in frame["wrapper"].sort_values():
            made = json.loads(w) if made is None else merge(made, json.loads(w))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(made)]})

    partial = distinct_pages(pages).mapInArrow(fold, "host string, wrapper string")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "salt").applyInPandas(
        join, "host string, wrapper string")
    return salted.groupBy("host").applyInPandas(join, "host string, wrapper string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows ``page_id, url, text, n_chars``: the main text of every page.

    The trees of a host's pages are aligned by simple tree matching into a wrapper. Its nodes with
    the same text in nearly all pages are template; the subtree with the varying text of the article
    is the content; elements marked as menus, adverts, forms, notices, comments and the like go.
    White space inside a block becomes one blank, blocks are joined by \\n.

    Null html: no text. Null or malformed url: the pages without a host share a wrapper. Repeated
    rows are each returned. No rows give no rows."""
    known = saved(wrappers(pages), "wrappers").select(F.col("host").alias("_host"), "wrapper")
    joined = (pages.select("page_id", "url", "html", host(F.col("url")).alias("_of"))
              .join(known, F.col("_of") == F.col("_host"), "left")
              .select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "wrapper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for source, w in zip(batch.column("html"), batch.column("wrapper").to_pylist(), strict=True):
                if w is not None and w not in read:
                    if len(read) >= 100:
                        read.clear()
                    read[w] = json.loads(w)
                texts.append(extract(source.as_py(), read.get(w)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_extract(spark, sf_dir):
    """Contract digest: ``extract_pages`` over all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))

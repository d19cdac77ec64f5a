"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with the path of open elements from the root (name and first class).  For each path
of a page the text length and the punctuation are summed over its blocks; their ratios to the number of blocks are fused
into one figure (with the share of text outside links), and the figures are smoothed over neighbouring blocks by the
likeness of their paths.  Names on a path (article, nav, a class such as "sidebar") are a prior: a factor of the figure,
which a large enough ratio outweighs.  Paths whose figure reaches the threshold are content:

- a path without a doubtful name needs SHARE of the page's largest figure;
- one with a word that may also be a heading's or a topic's ("menu-plan", "legal") needs that share and FLOOR;
- one with a name that says plainly what it is (nav, footer, class "comments") needs as much as the largest figure of the
  other paths, or FLOOR where there are no others.

The deepest element that holds nearly all content (or the next one around it that calls itself content) gives the text:
all its blocks in page order, so that its lists, tables, code and short paragraphs stay, but for elements in it with
doubtful names, which are kept or left out whole by their own mean figure.  Elements beside it whose paths are content
belong to it as well; beside an article or main element only those that call themselves content.  Where the page as a whole is the holder, parts before or after all content that are links for the
most part are left out.

Pages are read in one pass: each sign is looked at a fixed number of times, whatever is left open or unquoted.

Cases: null html counts as empty and gives an empty text, as does a page without content; repeated rows give repeated
results; text outside any element is a block of the root; unclosed elements end with their parents; a tag or comment that
never ends takes the rest of the page with it, as in browsers; nothing is cut; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, text_or_empty

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_content long"

#: Names of HTML elements by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg select object canvas audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mpadded mphantom mstyle mtable mtr mtd mmultiscripts mprescripts semantics".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": frozenset("li p".split()),
    "dt": frozenset("dt dd p".split()),
    "dd": frozenset("dt dd p".split()),
    "tr": frozenset("tr td th p".split()),
    "td": frozenset("td th p".split()),
    "th": frozenset("td th p".split()),
    "option": frozenset("option p".split()),
    "body": frozenset("head p".split()),
}
P = frozenset(("p",))
#: What ends a search for an element to close.
BOUNDS = {"li": frozenset("ul ol menu".split()), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
BOUND = frozenset("table td th body div section article main blockquote".split())
#: Elements and words of classes, ids and roles that say what is no main text.
PLAIN_ELEMENTS = frozenset("nav footer aside form dialog menu button fieldset".split())
#: ... plainly, wherever they stand in a name; plainly if they are the whole name; as a topic as well.
PLAIN = frozenset("ad ads comment comments commentlist disqus replies footer sidebar navbar topmenu submenu breadcrumb breadcrumbs cookie cookies consent gdpr advert adverts advertisement adsense sponsored newsletter masthead contentinfo complementary pagination pager".split())
WHOLE = frozenset("adv advertising sponsor sponsors promo promotion banner banners nav navigation menu foot widget widgets respond reply popup modal overlay share sharing toolbar topbar skip search hidden login signup subscribe subscription recommended recommendations notice notices notification".split())
TOPICS = frozenset("alert legal disclaimer header related social side aside copyright".split())
#: Elements whose ids are often made of a heading's words, and those of them that hold text themselves.
TEXTS = HEADINGS | frozenset("p li td th dt dd pre blockquote".split())
SLUGS = TEXTS | frozenset("section article".split())
QUOTES = frozenset("blockquote p pre td dd".split())
CONTENT = frozenset("article main post entry story content articlebody maincontent".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_STATE = re.compile(r"(?:has|with|no|is|js)[-_]", re.I)  # of the page rather than of the element
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?…](?!\S)|[。，]")  # not those within names and numbers
_NONE = re.compile(r"display\s*:\s*none")

#: Levels of doubt, and the factors of a figure that come with them; the factor of a content mark.
CLEAR, TOPIC, NAMED, SURE = 0, 1, 2, 3
PRIOR = (1.0, 0.3, 0.3, 0.01)
MARKED = 3.0
REACH, SHARE, FLOOR = 2, 0.2, 20.0


class Node:
    """An open element: its path (a number for each tag path of the page), doubt (the most around it), whether it is or
    lies in content, and the outermost element with that doubt."""

    __slots__ = ("name", "path", "up", "doubt", "part", "content", "within", "article", "hidden", "depth", "at")

    def __init__(self, name, path, up, doubt, content, hidden, at):
        self.name, self.path, self.up, self.content, self.at = name, path, up, content, at
        self.doubt, self.part = doubt, self if doubt else None
        self.within, self.article, self.hidden, self.depth = content, name in ("article", "main"), hidden, 0
        if up:
            self.depth = up.depth + 1
            self.within |= up.within
            self.article |= up.article
            self.hidden |= up.hidden
            if up.doubt >= doubt:
                self.doubt, self.part = up.doubt, up.part


def words(label: str) -> set[str]:
    return {w.lower() for x in label.split() if not _STATE.match(x) for w in (*_WORD.findall(x), *re.split(r"[_-]+", x))}


def doubt_of(name: str, found: dict[str, str], up: Node) -> int:
    """How much an element's name, class, id and role speak against main text."""
    if name in PLAIN_ELEMENTS or (name == "header" and not up.article):
        return SURE
    if not found or name in ("html", "body", "main"):
        return CLEAR
    labels = [found.get("class", ""), found.get("role", "")]
    if name not in SLUGS:
        labels.append(found.get("id", ""))
    whole = {x.lower() for label in labels for x in label.split()}
    if name not in TEXTS:
        whole.add(found.get("id", "").strip().lower())
    parts = set().union(*map(words, labels))
    if up.within and name in QUOTES and (whole | parts) & (PLAIN | WHOLE) <= {"comment"}:
        return CLEAR  # a remark that the text quotes, not a reader's
    if up.within and whole & (PLAIN | WHOLE) == {"menu"}:
        return TOPIC  # a meal's, if it holds sentences
    if whole & (PLAIN | WHOLE) or parts & PLAIN or len(parts & WHOLE) > 1:
        return SURE
    if name in TEXTS and up.within:
        return CLEAR
    if parts & WHOLE:
        return NAMED
    return TOPIC if (parts | whole) & TOPICS else CLEAR


def _opened(name: str, found: dict[str, str], up: Node, paths: dict, at: int) -> Node:
    doubt = doubt_of(name, found, up)
    if not found:
        return Node(name, paths.setdefault((up.path, name), len(paths) + 1), up, doubt, name in ("article", "main") and not doubt, False, at)
    label = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    step = name
    if found.get("class", "").strip():
        step = f"{name}.{re.sub(r'[0-9]+', '', found['class'].split()[0])}"
    content = name in ("article", "main") or found.get("itemprop", "").lower() == "articlebody"
    content |= name not in ("html", "body") and bool(label) and not words(label).isdisjoint(CONTENT)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(found.get("style", "")))
    return Node(name, paths.setdefault((up.path, step), len(paths) + 1), up, doubt, content and not doubt, hidden, at)


def _tag(page: str, at: int, never: set[str]) -> tuple[dict[str, str], int, bool]:
    """Attributes of the tag whose name ends at ``at``, where it ends, and whether it closes itself.

    A value that opens with a quote that nothing closes ends the tag at the next ``>``; never has the signs that no longer
    occur, so that they are looked for once.
    """
    found: dict[str, str] = {}
    if page.startswith(">", at):
        return found, at + 1, False
    while m := _ATTR.match(page, at):
        at = m.end()
        value = ""
        if m[2]:
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                stop = -1 if quote in never else page.find(quote, at + 1)
                if stop < 0:
                    never.add(quote)
                    stop = page.find(">", at)
                    return found, len(page) if stop < 0 else stop + 1, False
                value, at = page[at + 1 : stop], stop + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(m[1].lower(), value)
    stop = -1 if ">" in never else page.find(">", at)
    if stop < 0:
        never.add(">")
        return found, len(page), False
    return found, stop + 1, page[stop - 1] == "/"


def blocks(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(element, text, characters within links) of the page's text blocks in order, and all elements, outer ones first."""
    out: list[tuple[Node, str, int]] = []
    paths: dict[tuple[int, str], int] = {}
    node = Node("", 0, None, CLEAR, False, False, 0)
    nodes = [node]
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(page)
    never: set[str] = set()
    lower = ""

    def close() -> None:
        nonlocal linked
        if parts:
            if not node.hidden and (text := " ".join(references.unescape("".join(parts)).split())):
                out.append((node, text, linked))
            parts.clear()
        linked = 0

    def leave(to: Node) -> Node:
        """Closes elements up to and with ``to``."""
        up = node
        while True:
            open_[up.name] -= 1
            if up is to:
                return up.up
            up = up.up

    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        m = _NAME.match(page, start + 1)
        ends = False
        if not m and page.startswith("/", start + 1):
            m, ends = _NAME.match(page, start + 2), True
        if not m and not ends and page[start + 1 : start + 2] not in ("!", "?"):  # a sign of the text
            stop = start + 1
            parts.append(page[at:stop])
            linked += (stop - at) * in_link
            at = stop
            continue
        if start > at:
            parts.append(page[at:start])
            linked += (start - at) * in_link
        if not m:  # a comment, a declaration, or the end of nothing
            sign, skip, before = ("-->", 4, "<!--") if page.startswith("<!--", start) else ("]]>", 9, "<![CDATA[") if page.startswith("<![CDATA[", start) else (">", 2, "")
            stop = page.find(sign, start + skip)
            if before == "<![CDATA[":
                parts.append(page[start + skip : stop if stop >= 0 else size].replace("&", "&amp;"))
            at = size if stop < 0 else stop + len(sign)
            continue
        name = m[0].lower()
        found, at, itself = _tag(page, m.end(), never)
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE or name in MATH:
            if name == "a":
                in_link = not ends
            continue
        if ends:
            if name in RAW:
                continue
            close()
            in_link = False
            if open_.get(name):
                up = node
                while up.name != name:
                    up = up.up
                node = leave(up)
            continue
        if name in RAW:
            if not itself:
                lower = lower or page.lower()
                stop = lower.find(f"</{name}", at) if len(lower) == size else _find(page, name, at)
                at = size if stop < 0 else stop
            continue
        close()
        in_link = False
        if name in VOID:
            continue
        closes = CLOSES.get(name, P)
        bound = BOUNDS.get(name, BOUND)
        while any(open_.get(c) for c in closes):
            up = node
            while up.up and up.name not in bound and up.name not in closes:
                up = up.up
            if up.name not in closes or up.name in bound:
                break
            node = leave(up)
        node = _opened(name, found, node, paths, len(nodes))
        open_[name] = open_.get(name, 0) + 1
        nodes.append(node)
    if at < size:
        parts.append(page[at:])
    close()
    return out, nodes


def _find(page: str, name: str, at: int) -> int:
    m = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
    return m.start() if m else -1


def _alike(a: Node, b: Node) -> float:
    """Share of the steps from the root that the paths of two elements have in common."""
    most = max(a.depth, b.depth) + 1
    while a.path != b.path:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return (a.depth + 1) / most


def ratios(found: list[tuple[Node, str, int]]) -> dict[int, float]:
    """The fused ratio of each path: text length (its mean and spread) and punctuation a block, without linked text."""
    sums: dict[int, list[float]] = {}
    for node, text, linked in found:
        s = sums.setdefault(node.path, [0.0, 0.0, 0.0, 0.0, 0.0])
        for k, x in enumerate((len(text), len(_MARKS.findall(text)), 1, linked, len(text) ** 2)):
            s[k] += x
    out = {}
    for path, (chars, marks, n, linked, squares) in sums.items():
        spread = max(squares / n - (chars / n) ** 2, 0) ** 0.5
        out[path] = (chars / n + spread) * (0.2 + marks / n) * max(1 - linked / max(chars, 1), 0) ** 2
    return out


def figures(found: list[tuple[Node, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each block's own figure and its smoothed one, both with its prior."""
    fused = ratios(found)
    raw = [fused[b[0].path] for b in found]
    known: dict[tuple[int, int], float] = {}  # by paths
    prior = np.array([PRIOR[b[0].doubt] * (MARKED if b[0].within and not b[0].doubt else 1.0) for b in found])
    smooth = np.zeros(len(found))
    for i in range(len(found)):
        total = weight = 0.0
        for j in range(max(0, i - REACH), min(len(found), i + REACH + 1)):
            key = (found[i][0].path, found[j][0].path)
            if key not in known:
                known[key] = _alike(found[i][0], found[j][0]) ** 2
            w = known[key] * (1.0, 0.6, 0.3)[abs(i - j)]
            total += w * raw[j]
            weight += w
        smooth[i] = total / weight
    return np.array(raw) * prior, smooth * prior


def main_text(page: str) -> tuple[str, int, int]:
    """The main text, blocks that could be content, blocks taken."""
    found, nodes = blocks(page)
    if not found:
        return "", 0, 0
    own, smooth = figures(found)
    doubt = np.array([b[0].doubt for b in found])
    sure = doubt == SURE
    best = max(float(smooth[~sure].max()) if (~sure).any() else 0.0, 0.0)
    most = max(best, float(smooth.max()))
    bar = np.where(sure, best or FLOOR, np.where(doubt > 0, max(SHARE * most, FLOOR), SHARE * (best or most)))
    chosen = (smooth >= bar) & (smooth > 0)
    if not chosen.any():
        return "", len(found), 0
    mass = [0.0] * len(nodes)
    for (node, text, _), ok in zip(found, chosen, strict=True):
        mass[node.at] += len(text) * bool(ok)
    total = sum(mass)
    for node in reversed(nodes[1:]):
        mass[node.up.at] += mass[node.at]
    holder = max((n for n in nodes if mass[n.at] >= 0.8 * total), key=lambda n: n.depth)
    # a list item or paragraph that holds nearly all is part of its parent's text
    while holder.up and holder.name in ("p", "li", "ul", "ol", "td", "tr", "tbody", "table", "blockquote", "pre", "dl", "dd", "dt", *HEADINGS) and holder.up.name not in ("", "html", "body"):
        holder = holder.up
    outer = holder
    while outer and not outer.content:
        outer = outer.up
    holder = outer or holder
    around, up = set(), holder.up
    while up:
        around.add(up.at)
        up = up.up
    # for each element the holder, or the outermost one that is beside the holder or what is around it
    parts: list[Node] = []
    for node in nodes:
        parts.append(node if node.at in around or node is holder or not node.up or node.up.at in around else parts[node.up.at])
    kept = _kept(found, own, smooth, holder)
    beside = [parts[b[0].at] for b, c, o in zip(found, chosen, own >= bar, strict=True) if c and o]
    # beside an element that says it is the text only others that say so belong to it
    taken = {n.at for n in beside if n.within or not holder.article} | {holder.at}
    whole = holder.name in ("", "html", "body")
    first, last = 0, len(found)
    menus: dict[int, list[float]] = {}
    if whole:
        at = np.flatnonzero(chosen & (own >= bar))
        first, last = (at[0], at[-1]) if len(at) else (0, len(found))
        below: list[Node] = []
        for node in nodes:
            below.append(node if not node.up or node.up is holder or node is holder or not below[node.up.at].up else below[node.up.at])
        for k, (node, text, linked) in enumerate(found):
            sums = menus.setdefault(below[node.at].at, [0.0, 0.0, 0.0])
            for place, x in enumerate((len(text), linked, first <= k <= last)):
                sums[place] += x
    texts = []
    for (node, text, _), c, k in zip(found, chosen, kept, strict=True):
        title = node.name in HEADINGS and node.up is holder.up and (node.content or node.name == "h1") and not node.doubt  # beside its text
        part = parts[node.at]
        if not title and (part.at not in taken or not (k if part is holder else c or not node.doubt)):
            continue
        if whole and node is not holder:
            chars, linked, within = menus[below[node.at].at]
            if not within and linked > chars / 2:
                continue
        texts.append(text)
    return " ".join(texts), len(found), len(texts)


def _kept(found: list[tuple[Node, str, int]], own: np.ndarray, smooth: np.ndarray, holder: Node) -> np.ndarray:
    """Which blocks stay if they lie in the holder: those without a doubt of their own there, and those of doubtful
    elements whose mean figure reaches FLOOR and, but for topics, the share that a path needs."""
    clear = [i for i, b in enumerate(found) if b[0].doubt <= holder.doubt]
    most = float(smooth[clear].max()) if clear else 0.0
    sums: dict[int, list[float]] = {}
    for i, (node, text, _) in enumerate(found):
        if node.doubt > holder.doubt:
            s = sums.setdefault(node.part.at, [0.0, 0.0])
            s[0] += own[i] * len(text)
            s[1] += len(text)
    out = np.ones(len(found), bool)
    for i, (node, _, _) in enumerate(found):
        if node.doubt > holder.doubt:
            mean = sums[node.part.at][0] / sums[node.part.at][1]
            share = {TOPIC: 0.0, NAMED: SHARE * PRIOR[NAMED], SURE: 1.0}[node.doubt]
            out[i] = mean >= max(FLOOR, share * most)
    return out


def _extract(batches):
    for batch in slices(batches):
        rows = [main_text(p) for p in batch.column(2).to_pylist()]
        texts = [r[0] for r in rows]
        arrays = [batch.column(0), batch.column(1), pa.array(texts), pa.array(list(map(len, texts)), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])


def extract(pages: DataFrame) -> DataFrame:
    """SCHEMA: a row for each page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(_extract, SCHEMA)

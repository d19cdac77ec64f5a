"""Declarations of a Java source: a tree of types, with their members by kind, nested to any depth.

Brackets are paired in one pass over the masked text.  A type's body is then read member by member, in which a bracket and
what is in it are one step; types that stand in the bodies of methods and blocks are found there and read the same way.
What is never closed ends with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Java's words for types, modifiers, and what stands before a bracket without being a method.
TYPES = frozenset("class interface enum record".split())
MODIFIERS = frozenset("public protected private static final synchronized abstract native strictfp default".split())
NO_METHODS = frozenset("if for while switch catch synchronized try return throw new case else do".split())

_QUOTED = re.compile(r'"""[\s\S]*?(?:"""|\Z)|"(?:\\[\s\S]|[^"\\])*(?:"|\Z)|\'(?:\\[\s\S]|[^\'\\])*(?:\'|\Z)|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)')
_VISIBLE = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[()\[\]{}]")
_TOKEN = re.compile(r"@\s*(?P<mark>[A-Za-z_$][\w$.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<sign>[()\[\]{},;=])")
_THROWS = re.compile(r"\s*(?:throws\s[^;{}()]*)?\Z")
_LOCAL = re.compile(r"(?<![\w.$])(?:class|interface|enum|record)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^;{}]*>)?\s*(?:\([^;{}]*\))?[^;{}()]*\{")


def mask(code: str) -> str:
    """Comments, strings, characters and text blocks become blanks; length and line ends stay."""
    return _QUOTED.sub(lambda m: _VISIBLE.sub(" ", m[0]), code)


def pairs(text: str) -> dict[int, int]:
    """Opening bracket's place -> its closing one's; a brace also ends the brackets that were left open in it."""
    out: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    braces = 0
    for m in _BRACKET.finditer(text):
        sign, at = m[0], m.start()
        if sign in "([{":
            open_.append((sign, at))
            braces += sign == "{"
            continue
        want = "([{"[")]}".index(sign)]
        if open_ and (open_[-1][0] == want or (want == "{" and braces)):
            while open_:
                opened, place = open_.pop()
                out[place] = at
                if opened == want:
                    break
            braces -= want == "{"
    for _, place in open_:
        out[place] = len(text)
    return out


@dataclass
class Node:
    """A type, method, field or block: where its text starts and ends, and its body's brackets (-1 without a body)."""

    kind: str
    name: str
    start: int
    end: int
    opens: int = -1
    closes: int = -1
    annotations: list[str] = field(default_factory=list)
    parameters: int = 0
    constructor: bool = False
    void: bool = False
    enum: bool = False
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def owner(self) -> str:
        """The path of the types around it."""
        names, above = [], self.parent
        while above is not None:
            if above.kind == "type":
                names.append(above.name)
            above = above.parent
        return ".".join(reversed(names))

    @property
    def depth(self) -> int:
        """How many types it stands in."""
        return self.owner.count(".") + 1 if self.owner else 0

    def key(self) -> str:
        return f"{self.kind}:{self.name}" + (f"/{self.parameters}" if self.kind == "method" else "")

    def walk(self) -> Iterator[Node]:
        """All that is in it, in the order of the text."""
        waiting = self.children[::-1]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += node.children[::-1]


class _Head:
    """What has been read of a member: from ``start``, its annotations, words and names with parentheses."""

    def __init__(self, start: int):
        self.start = start
        self.annotations: list[str] = []
        self.words: list[tuple[str, int]] = []
        self.call: tuple[str, int, int, int] | None = None  # a name's place among the words, its brackets
        self.assigned = -1


class Source:
    """A source's masked text, its brackets and its tree of declarations."""

    def __init__(self, code: str):
        self.code = code
        self.text = mask(code)
        self.pairs = pairs(self.text)
        self.root = Node("file", "", 0, len(self.text), 0, len(self.text))
        self.waiting = [(self.root, 0, len(self.text))]
        while self.waiting:  # bodies of types that were found, however deep
            self._body(*self.waiting.pop())

    def nodes(self, kind: str) -> list[Node]:
        return [n for n in self.root.walk() if n.kind == kind]

    def methods(self) -> list[Node]:
        """Methods with a body, no constructors, in the order of the text."""
        return [n for n in self.nodes("method") if n.opens >= 0 and not n.constructor]

    def body(self, node: Node) -> str:
        return self.text[node.opens : node.closes + 1]

    def source(self, node: Node) -> str:
        return self.code[node.start : node.end].strip()

    def _body(self, parent: Node, start: int, end: int) -> None:
        """Members of a type (or of the file) that stand between two places."""
        head, at, last = _Head(start), start, None
        listing = parent.enum  # an enum's constants come first, up to a semicolon
        while m := _TOKEN.search(self.text, at, end):
            at = m.end()
            if m["mark"] and m["mark"] != "interface":
                head.annotations.append(m["mark"].rpartition(".")[2])
                last = None
            elif m["mark"] or m["word"]:
                last = (m["mark"] or m["word"], m.end())
                head.words.append(last)
            elif m["sign"] in "([":
                close = self.pairs[m.start()]
                if m["sign"] == "(" and last and head.assigned < 0 and not self.text[last[1] : m.start()].strip():
                    head.call = (last[0], len(head.words) - 1, m.start(), close)
                at, last = min(close + 1, end), None
            elif m["sign"] == "{":
                close = self.pairs[m.start()]
                at, last = min(close + 1, end), None
                if head.assigned < 0 and not listing:  # else a value, or a constant's body: it goes on
                    self._braced(parent, head, m.start(), close)
                    head = _Head(at)
            elif m["sign"] == ";" or (m["sign"] == "," and listing):
                self._constant(parent, head, m.start()) if listing else self._ended(parent, head, m.start())
                listing = listing and m["sign"] == ","
                head, last = _Head(at), None
            elif m["sign"] == "=":
                head.assigned = m.start() if head.assigned < 0 else head.assigned
                last = None
            else:
                last = None
        if listing:
            self._constant(parent, head, end)

    def _constant(self, parent: Node, head: _Head, at: int) -> None:
        if head.words:
            parent.children.append(Node("field", head.words[0][0], head.start, at + 1, annotations=head.annotations, parent=parent))

    def _braced(self, parent: Node, head: _Head, opens: int, closes: int) -> None:
        """A type, method or block whose body begins."""
        words = [w for w, _ in head.words]
        named = next((words[i + 1] for i, w in enumerate(words[:-1]) if w in TYPES), None)
        node = Node("block", str(len(parent.children)), head.start, min(closes + 1, parent.closes), opens, min(closes, len(self.text) - 1), head.annotations, parent=parent)
        if named and (head.call is None or "record" in words):
            node.kind, node.name, node.enum = "type", named, "enum" in words
        elif parent.kind == "type" and head.call and self._is_method(parent, head, opens):
            self._signature(node, head)
        parent.children.append(node)
        if node.kind == "type":
            self.waiting.append((node, opens + 1, closes))
        else:
            self._locals(node, opens + 1, closes)

    def _is_method(self, parent: Node, head: _Head, opens: int) -> bool:
        """A name with parameters, a type or the class's own name before them, nothing but throws behind, no control word."""
        name, place, _, close = head.call
        before = [w for w, _ in head.words[:place] if w not in MODIFIERS]
        if name in NO_METHODS or (head.words and head.words[0][0] in NO_METHODS) or not _THROWS.match(self.text, close + 1, opens):
            return False
        return bool(before) or name == parent.name

    def _signature(self, node: Node, head: _Head) -> None:
        name, place, opens, closes = head.call
        before = [w for w, _ in head.words[:place] if w not in MODIFIERS]
        inner = outside(outside(self.text[opens + 1 : closes]), "<>").strip()
        node.kind, node.name, node.parameters = "method", name, inner.count(",") + 1 if inner else 0
        node.constructor, node.void = not before, before[-1:] == ["void"]

    def _ended(self, parent: Node, head: _Head, at: int) -> None:
        """A member without a body: a method of an interface, or fields, one for each name."""
        if parent.kind != "type" or not head.words:
            return
        if head.call and head.assigned < 0 and [w for w, _ in head.words[: head.call[1]] if w not in MODIFIERS]:
            node = Node("method", "", head.start, at + 1, annotations=head.annotations, parent=parent)
            self._signature(node, head)
            parent.children.append(node)
            return
        for name in names_of(self.text[head.start : at]):
            parent.children.append(Node("field", name, head.start, at + 1, annotations=head.annotations, parent=parent))

    def _locals(self, parent: Node, start: int, end: int) -> None:
        """Types in the body of a method or block."""
        at = start
        while m := _LOCAL.search(self.text, at, end):
            opens = m.end() - 1
            closes = self.pairs[opens]
            node = Node("type", m["name"], m.start(), min(closes + 1, end), opens, min(closes, len(self.text) - 1), parent=parent)
            node.enum = m[0].lstrip().startswith("enum")
            parent.children.append(node)
            self.waiting.append((node, opens + 1, closes))
            at = max(closes, opens) + 1


def outside(text: str, pair: str = "()") -> str:
    """text without what stands in parentheses (or another pair of brackets)."""
    a, b = map(re.escape, pair)
    while (new := re.sub(f"{a}[^{a}{b}]*{b}", " ", text)) != text:
        text = new
    return text


def names_of(declaration: str) -> list[str]:
    """Names that a masked field declaration (or an enum's list of constants) declares."""
    for pair in ("()", "{}", "[]"):
        declaration = outside(declaration, pair)
    while (new := re.sub(r"<[\w\s.,?&\[\]]*>", " ", declaration)) != declaration:
        declaration = new
    found = [re.search(r"([A-Za-z_$][\w$]*)\s*(?:=[\s\S]*)?\Z", part) for part in re.sub(r"@[\w.]+", " ", declaration).split(",")]
    return [m[1] for m in found if m]

"""What two sources have in common beyond their tokens: the shapes of their bracketed parts and how values flow.

A part is what a pair of brackets holds.  Its shape is the row of its signs and words, names as one kind, numbers as another,
keywords as they are, and in place of an inner part that part's shape; shapes are hashed, so that a part stands for all that
is in it.  A flow is an edge from a variable to one that its value is made of, both named by the order of their first
assignment.  Both are multisets, and a score is the share of the reference's that the candidate has.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .declarations import mask, pairs
from .java import _udf
from .text import bound, numbered

#: Java's words that are part of a shape as they are.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new "
    "package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[()\[\]{}]|[^\s\w]")
_NAME = re.compile(r"(?<![\w.$])[A-Za-z_$][\w$]*(?!\s*[\w$(])")
_SET = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*([-+*/%&|^]|<<|>>>?)?=(?![=])")


def shapes(code: str) -> list[str]:
    """Hashes of the shapes of a source's parts, inner ones before those around them, the whole source last."""
    text = mask(code)
    ends = pairs(text)
    closes = set(ends.values())
    out: list[str] = []
    open_: list[list[str]] = [[]]
    for m in _TOKEN.finditer(text):
        token, at = m[0], m.start()
        if at in closes and token in ")]}":
            shape = hashlib.sha256(" ".join(open_[-1]).encode()).hexdigest()[:16]
            if len(open_) > 1:
                open_.pop()
                out.append(shape)
                open_[-1].append(shape)
        elif token in "([{":
            open_.append([token])
        else:
            first = token[0]
            open_[-1].append(token if token in KEYWORDS or not (first.isalnum() or first in "_$") else "0" if first.isdigit() else "name")
    while open_:
        shape = hashlib.sha256(" ".join(open_.pop()).encode()).hexdigest()[:16]
        out.append(shape)
        if open_:
            open_[-1].append(shape)
    return out


def flows(code: str) -> list[str]:
    """Edges ``a<b`` of a source's statements in order: variable a is set from variable b, by their numbers; a variable that
    is set from no other one has the edge ``a<``, and one that an operator is applied to is set from itself as well."""
    numbers: dict[str, int] = {}
    out: list[str] = []
    for statement in re.split(r"[;{}]", mask(code)):
        m = _SET.search(statement)
        if not m:
            continue
        used = [n for n in _NAME.findall(statement[m.end() :]) if n not in KEYWORDS and n in numbers]
        if m[2] and m[1] in numbers:
            used.insert(0, m[1])
        number = numbers.setdefault(m[1], len(numbers))
        out += [f"{number}<{numbers[n]}" for n in used] or [f"{number}<"]
    return out


def shapes_column(code: Column) -> Column:
    return _udf(shapes, "array<string>")(code)


def flows_column(code: Column) -> Column:
    return _udf(flows, "array<string>")(code)


def found_share(candidate: Column, reference: Column) -> Column:
    """Of the reference's multiset the share that the candidate's has; null where the reference has nothing."""

    def of(row: Column) -> Column:
        a, b = row["a"], row["b"]
        return F.when(F.size(b) > 0, F.size(F.array_intersect(numbered(a), numbered(b))) / F.size(b))

    return bound(F.struct(F.coalesce(candidate, F.array().cast("array<string>")).alias("a"), reference.alias("b")), of)

"""Lexical functions over source text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token and name patterns, comments and literals as the measures of likeness take them.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|==|!=|<=|>=|&&|\|\||[{}()\[\];.,+\-*/%<>=!&|^~?:]"
NAME_PART = r"[A-Z]+(?=[A-Z][a-z]|\d|$)|[A-Z]?[a-z]+|[A-Z]+|\d+"
IMPORT = r"(?m)^\s*import\s+(?!static\b)([\w.]+(?:\.\*)?)\s*;?"
COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"
STRING, CHARACTER = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])'"
TEST_MARKS = ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory")
#: Joins the tokens of a shingle; no token holds it.
JOINT = "\u0001"


def strip_comments(code: Column) -> Column:
    return F.regexp_replace(code, COMMENT, "")


def strip_comments_keep_strings(code: Column) -> Column:
    """Comments go, string literals stay as they are, with what looks like a comment in them."""
    return F.regexp_replace(code, r'(?s)("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', "$1")


def normalize_literals(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code, STRING, '"<STR>"'), CHARACTER, "'<CHR>'")


def tokenize(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used, also within lambdas."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def numbered(values: Column) -> Column:
    """Each of an array of strings with its number among its equals before it, so that array_intersect() compares multisets."""
    return bound(F.sort_array(values), lambda s: F.transform(s, lambda v, i: F.concat((i + 1 - F.array_position(s, v)).cast("string"), F.lit(":"), v)))


def shingles(tokens: Column, k: int = 5) -> Column:
    """The set of k tokens in a row; fewer tokens are one shingle, none give the empty set."""

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), JOINT))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return bound(tokens, of)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets; both_empty is 1 or 0 by convention, one empty set gives 0."""

    def of(s: Column) -> Column:
        x, y, common = F.size(s["a"]), F.size(s["b"]), F.size(F.array_intersect(s["a"], s["b"]))
        return F.when((x == 0) & (y == 0), F.lit(float(both_empty))).otherwise(common / (x + y - common))

    return bound(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), of)


def containment(a: Column, b: Column) -> Column:
    """Share of a's set that b holds; null if a is empty."""
    x = F.size(F.array_distinct(a))
    return F.when(x > 0, F.size(F.array_intersect(a, b)) / x)


def imports(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(IMPORT), F.lit(1)))


def name_tokens(name: Column) -> Column:
    """Lower-cased parts of a camel, snake or mixed name; acronyms and digit runs are parts of their own."""
    return F.transform(F.regexp_extract_all(F.translate(name, "_", " "), F.lit(NAME_PART), F.lit(0)), F.lower)


def separator(name: Column) -> Column:
    return F.when(name.contains("_"), "underscore").otherwise("camel")


def name_prefix(parts: Column) -> Column:
    """What a name's first part makes of it: test, should, scenario (given or when) or bare."""
    first = F.try_element_at(parts, F.lit(1))
    return F.when(first.isin("test", "should"), first).when(first.isin("given", "when"), "scenario").otherwise("bare")


def name_shape(name: Column) -> Column:
    """struct<prefix, separator, lexical>: prefix and separator of the name, and the number of its other words."""
    parts = name_tokens(name)
    prefix = name_prefix(parts)
    rest = F.when(prefix != "bare", F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    lexical = F.size(F.filter(rest, lambda p: ~p.rlike(r"^\d+$")))
    return F.struct(prefix.alias("prefix"), separator(name).alias("separator"), lexical.alias("lexical"))


def humanize(name: Column) -> Column:
    """A method name as words: its test or should goes, camel case and underscores become spaces."""
    bare = F.regexp_replace(name, r"^(test|should)(?=[A-Z_])_?", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, r"([a-z0-9])([A-Z])", "$1 $2"), "_+", " ")
    return F.lower(F.trim(spaced))


def kebab_to_camel(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "-"), F.initcap), "")


def without_stop_words(text: Column, stop: list[str]) -> Column:
    """The set of words longer than one letter that are not stop words."""
    kept = F.filter(words(text), lambda w: F.length(w) > 1)
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(s) for s in stop]))


def package_of(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"(?m)^\s*package\s+([\w.]+)\s*;", 1), F.lit(""))


def class_of(code: Column, stem: Column) -> Column:
    """The declared type named like the file, else the first one, else the file's stem."""
    found = F.regexp_extract_all(code, F.lit(r"(?m)\b(?:class|interface|enum|record)\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    return F.when(F.array_contains(found, stem), stem).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), stem))


def fqcn_of_path(path: Column) -> Column:
    """Dotted name of a source path, from below its java or kotlin root."""
    inner = F.regexp_extract(path, r"(?:^|.*/)(?:java|kotlin)/(.+)\.(?:java|kt)$", 1)
    bare = F.regexp_extract(path, r"([^/]+)\.(?:java|kt)$", 1)
    return F.translate(F.when(inner != "", inner).otherwise(bare), "/", ".")


def junit_version(code: Column) -> Column:
    return F.when(code.contains("org.junit.jupiter"), 5).otherwise(4)


def balanced(code: Column) -> Column:
    """Braces never close more than is open and end closed, with ``}`` as the last sign."""
    marks = F.regexp_extract_all(code, F.lit(r"[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok"))
    step = lambda s, m: F.struct((s.d + F.when(m == "{", 1).otherwise(-1)).alias("d"), (s.ok & (s.d + F.when(m == "{", 1).otherwise(-1) >= 0)).alias("ok"))
    return F.aggregate(marks, start, step, lambda s: s.ok & (s.d == 0)) & F.trim(code).endswith("}")


def test_file_name(name: Column) -> Column:
    return F.lower(name).rlike(r"(test|tests|it|its|testcase|testcases)\.java$")


def test_names_of(source: Column) -> Column:
    """Names a test of class ``source`` may have."""
    return F.array(F.concat(source, F.lit("Test")), F.concat(source, F.lit("Tests")), F.concat(source, F.lit("IT")), F.concat(F.lit("Test"), source))


def glob_to_regex(pattern: str) -> str:
    """Shell pattern (* ? [..]) to a regular expression for the whole text; empty and * match all."""
    if pattern in ("", "*"):
        return ".*"
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (j := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = j
        elif c in "*?":
            out += ".*" if c == "*" else "."
        else:
            out += c if c.isalnum() else "\\" + c
        i += 1
    return f"(?s)^{out}$"

"""Rows and texts of reports: selected tests, stage summaries, compare rows, line blocks, sources and context of a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codematch, java, scalars, text
from .ordered import merged
from .ranking import ORDERS, largest_span, order_of, top_k, within_budget

#: Where a repository's contributing file may be, and what a candidate's path must hold to be a source root.
CONTRIBUTING = ("CONTRIBUTING.md", "contributing.md", ".github/CONTRIBUTING.md", ".github/contributing.md", "docs/CONTRIBUTING.md", "docs/contributing.md")
ROOTS = ("src/main/java/", "src/test/java/")
COUNT_WORDS = ("one", "two")
COMPARED = ("auto_pmd_violations", "candidate_pmd_violations", "cpd_duplicate_blocks", "cpd_duplicate_lines_total")


def selected_tests(candidates: DataFrame, keys: list[str], runnable: DataFrame, most: int = 2) -> DataFrame:
    """The first ``most`` tests of each target by the order of submitted tests, of those that can be run and add something.

    candidates: keys, test_method, added_* and measured columns of every source, in one table; runnable: keys, test_method.
    A method that comes from several sources counts once, with its best row.
    """
    added = F.greatest("added_lines", "added_branches", "added_methods", "added_instructions") > 0
    order = [c.replace("test_selector", "test_method") for c in ORDERS["pr"]]
    some = candidates.where(added).join(runnable.select(*keys, "test_method").distinct(), [*keys, "test_method"], "left_semi")
    return top_k(top_k(some, [*keys, "test_method"], order, 1), keys, order, most)


def compile_summary(requested: DataFrame, final: DataFrame, status: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, selected, requested_test_count, requested_test_cases, final_source_count, resolved_support_source_count,
    problem_category: a row for each requested target.

    requested and final: keys, source; status: keys, compiled, problem.  Support sources are final ones that nobody asked
    for; a target without a status is planned, and keeps no problem once it compiled.
    """
    asked = requested.groupBy(*keys).agg(F.array_sort(F.collect_set("source")).alias("__asked"), F.count("source").alias("requested_test_count"))
    built = final.groupBy(*keys).agg(F.collect_set("source").alias("__built"), F.count("source").alias("final_source_count"))
    rows = asked.join(built, keys, "left").join(status, keys, "left")
    state = F.when(F.col("compiled").isNull(), "planned").when(F.col("compiled"), "compiled").otherwise("failed")
    return rows.select(
        *keys,
        state.alias("status"),
        F.lit(False).alias("selected"),
        "requested_test_count",
        F.array_join("__asked", ";").alias("requested_test_cases"),
        F.coalesce("final_source_count", F.lit(0)).alias("final_source_count"),
        F.coalesce(F.size(F.array_except("__built", "__asked")), F.lit(0)).alias("resolved_support_source_count"),
        F.when(~F.col("compiled"), F.col("problem")).alias("problem_category"),
    )


def stage_event(rows: DataFrame, outputs: DataFrame, keys: list[str], counts: dict[str, str]) -> DataFrame:
    """Events of a stage with the row counts of its outputs (name of the new column -> value of ``kind``), 0 where there
    are none."""
    kinds = [F.count_if(F.col("kind") == kind).alias(name) for name, kind in counts.items()]
    return rows.join(outputs.groupBy(*keys).agg(*kinds), keys, "left").na.fill(0, list(counts))


def compare_rows(measures: DataFrame, keys: list[str], include_auto: bool = True, auto: str = "auto", candidate: str = "adopted") -> DataFrame:
    """keys, variant and COMPARED: a row for each target and variant.  Figures of the candidate and of duplicates are null
    in the row of the automatic variant: they are not zero, they do not apply."""
    rows = []
    for variant in ([auto] if include_auto else []) + [candidate]:
        own = [COMPARED[0]] if variant == auto else list(COMPARED)
        rows.append(measures.select(*keys, F.lit(variant).alias("variant"), *[F.col(c) if c in own else F.lit(None).cast(measures.schema[c].dataType).alias(c) for c in COMPARED]))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def has_contributing(files: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """repo, has_contributing: whether any of the usual places holds the file."""
    return files.groupBy(repo).agg(F.coalesce(F.bool_or(F.col(path).isin(*CONTRIBUTING)), F.lit(False)).alias("has_contributing"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def expanded_sources(selected: DataFrame, files: DataFrame, keys: list[str], scaffolding: str = "_scaffolding") -> DataFrame:
    """keys, path, is_selected: the selected files, and the other sources in their folders that are neither tests nor
    scaffolding; each path of a key once."""
    own = selected.select(*keys, "path", F.lit(True).alias("is_selected"))
    folders = selected.select(*keys, folder_of(F.col("path")).alias("__folder")).distinct()
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    helpers = files.where(F.col("path").endswith(".java") & ~name.contains(scaffolding) & ~text.test_file_name(name))
    beside = helpers.withColumn("__folder", folder_of(F.col("path"))).join(folders, [c for c in keys if c in files.columns] + ["__folder"])
    both = own.unionByName(beside.select(*keys, "path", F.lit(False).alias("is_selected")))
    return both.groupBy(*keys, "path").agg(F.bool_or("is_selected").alias("is_selected"))


def first_source(files: DataFrame, fqcn: str, path: str = "path") -> DataFrame:
    """fqcn, path: the first path, in order, of each class that files declare."""
    return files.where(F.col(fqcn).isNotNull()).groupBy(fqcn).agg(F.min(path).alias(path))


def scaffolding_of(files: DataFrame, suffix: str = "_ESTest", scaffolding: str = "_ESTest_scaffolding") -> DataFrame:
    """path, scaffolding: each generated test's sibling of the same name that holds its scaffolding."""
    stem = lambda s: F.regexp_replace("path", s + r"\.java$", "")
    tests = files.where(F.col("path").rlike(suffix + r"\.java$")).select("path", stem(suffix).alias("__stem"))
    return tests.join(files.where(F.col("path").rlike(scaffolding + r"\.java$")).select(F.col("path").alias("scaffolding"), stem(scaffolding).alias("__stem")), "__stem").drop("__stem")


def package_context(files: DataFrame, keys: list[str], package: str, most_files: int = 12, most_chars: int = 40_000) -> DataFrame:
    """keys, path, text: the sources of a target's package below the usual roots, main ones first and by path, until the
    number of files or of characters is spent; the last text is cut to what is left.  Without a package all sources count."""
    inside = F.replace(F.coalesce(F.col(package), F.lit("")), F.lit("."), F.lit("/"))
    place = F.lit(None).cast("int")
    for i, root in reversed(list(enumerate(ROOTS))):
        folder = F.concat(F.lit(root), inside, F.when(inside == "", "").otherwise("/"))
        place = F.when(F.col("path").startswith(folder), F.lit(i)).otherwise(place)
    rows = files.where(F.col("path").endswith(".java") & (F.length("text") > 0)).withColumn("__root", place).where("__root is not null")
    once = rows.groupBy(*keys, "path").agg(F.min("__root").alias("__root"), F.min("text").alias("text"))
    kept = within_budget(once.withColumn("__size", F.length("text")), keys, ("__root", "path"), "__size", most_chars, most_files)
    return kept.select(*keys, "path", F.substring("text", F.lit(1), F.col("taken").cast("int")).alias("text"))


def line_blocks(spans: DataFrame, lines: DataFrame, keys: list[str], most: int = 25) -> DataFrame:
    """keys, start, end, shown, others: the largest of each key's spans (merged where they touch), its first ``most`` source
    lines with tabs as four blanks and HTML signs escaped, and the other spans as ``a-b;c``."""
    whole = merged(spans, keys, "start", "end")
    largest = largest_span(whole, keys)
    rest = whole.join(largest.select(*keys, F.col("start").alias("__start")), keys).where("start <> __start")
    token = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    others = rest.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", token.alias("token")))), lambda s: s["token"]), ";").alias("others"))
    plain = F.col("line")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\t", "    ")):
        plain = F.replace(plain, F.lit(sign), F.lit(name))
    near = lines.join(largest, keys).where((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.least(F.col("end"), F.col("start") + F.lit(most - 1))))
    shown = near.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", plain.alias("line")))), lambda s: s["line"]), "\n").alias("shown"))
    return largest.join(shown, keys, "left").join(others, keys, "left").select(*keys, "start", "end", F.coalesce("shown", F.lit("")).alias("shown"), F.coalesce("others", F.lit("")).alias("others"))


def with_comments(lines: DataFrame, comments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, line: source lines with each comment (keys, pos, comment) put before the line at pos, at its indent; lines
    of earlier comments (a block that begins with the same words) are the caller's to drop with without_comments()."""
    noted = lines.join(comments.select(*keys, "pos", "comment"), [*keys, "pos"], "left")
    indent = F.regexp_extract("line", r"^(\s*)", 1)
    pieces = F.when(F.col("comment").isNull(), F.array("line")).otherwise(F.array(F.concat(indent, F.col("comment")), F.col("line")))
    spread = noted.select(*keys, "pos", F.posexplode(pieces).alias("__at", "line"))
    w = Window.partitionBy(*keys).orderBy("pos", "__at")
    return spread.withColumn("pos", F.row_number().over(w)).drop("__at")


def without_comments(lines: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """keys, pos, line without the comment lines that hold ``mark``, renumbered."""
    w = Window.partitionBy(*keys).orderBy("pos")
    kept = lines.where(~(F.trim("line").rlike(r"^(//|\*|/\*)") & F.col("line").contains(mark)))
    return kept.withColumn("pos", F.row_number().over(w))


def count_word(n: Column) -> Column:
    """one, two, else the number."""
    out = n.cast("string")
    for i, word in enumerate(COUNT_WORDS, 1):
        out = F.when(n == i, word).otherwise(out)
    return out


def selection_text(selected: DataFrame, keys: list[str], component: str, order: str = "rank") -> DataFrame:
    """keys, heading, title, listing, summary of the tests (test_method) that were selected for each key."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(order, "test_method"))), lambda s: s["test_method"])
    rows = selected.groupBy(*keys, component).agg(names.alias("__names"), F.count(F.lit(1)).alias("__n"))
    one = F.col("__n") == 1
    noun = F.when(one, "regression test").otherwise("regression tests")
    amount = F.when(one, F.concat(F.lit("a "), noun)).otherwise(F.concat_ws(" ", count_word(F.col("__n")), noun))
    return rows.select(
        *keys,
        F.when(one, "Test Added").otherwise("Tests Added").alias("heading"),
        F.concat(F.lit("test: add "), noun, F.lit(" for "), F.col(component)).alias("title"),
        F.array_join(F.transform("__names", lambda n: F.concat(F.lit("* Added "), n)), "\n").alias("listing"),
        F.concat(F.lit("I added "), amount, F.lit(" for "), F.col(component), F.lit(" around "), F.array_join(F.transform("__names", text.humanize), " and "), F.lit(".")).alias("summary"),
    )


def import_hints(sources: DataFrame, keys: list[str], code: str = "text") -> DataFrame:
    """keys, symbol, packages: for each imported class the packages it is imported from; a static import counts for its
    class, wildcards for none."""
    targets = F.regexp_extract_all(code, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)+)\s*;\s*$"), F.lit(1))
    rows = sources.select(*keys, F.explode(targets).alias("__target")).withColumn("__parts", F.split("__target", r"\."))
    last, n = F.element_at("__parts", -1), F.size("__parts")
    static = last.rlike("^[a-z]") & (n >= 2)
    symbol = F.when(static, F.try_element_at("__parts", F.lit(-2))).otherwise(last)
    rows = rows.withColumn("symbol", symbol).withColumn("package", F.array_join(F.slice("__parts", 1, F.greatest(n - F.when(static, 2).otherwise(1), F.lit(0))), "."))
    return rows.groupBy(*keys, "symbol").agg(F.array_sort(F.collect_set("package")).alias("packages"))


def missing_imports(sources: DataFrame, declared: DataFrame, keys: list[str], code: str = "text") -> DataFrame:
    """keys, package, symbol: imported classes that no declared source has."""
    hints = import_hints(sources, keys, code).select(*keys, "symbol", F.explode("packages").alias("package"))
    return hints.join(declared.select("package", "symbol").distinct(), ["package", "symbol"], "left_anti").select(*keys, "package", "symbol")


def declaring_sources(wanted: DataFrame, files: DataFrame, present: DataFrame) -> DataFrame:
    """package, symbol, path: the first file, in order, that declares each wanted class, unless it is present already."""
    first = files.groupBy("package", "symbol").agg(F.min("path").alias("path"))
    return wanted.select("package", "symbol").distinct().join(first, ["package", "symbol"]).join(present.select("path").distinct(), "path", "left_anti").select("package", "symbol", "path")


def ngram_score(candidate: Column, reference: Column, weights: dict[str, float] | None = None, most: int = 4) -> Column:
    """BLEU of two token arrays with 1- to ``most``-grams, add-one smoothed beyond single tokens, and the brevity penalty;
    single tokens weigh what ``weights`` gives them (1 if it names them not).  Null where either has no tokens."""

    def of(row: Column) -> Column:
        a, b = row["a"], row["b"]
        logs = [F.log(_matched(a, b, n, weights)) for n in range(1, most + 1)]
        brevity = F.least(F.lit(0.0), 1 - F.size(b) / F.size(a))
        return F.when((F.size(a) > 0) & (F.size(b) > 0), F.coalesce(F.exp(sum(logs[1:], logs[0]) / most + brevity), F.lit(0.0)))

    return text.bound(F.struct(candidate.alias("a"), reference.alias("b")), of)


def _matched(a: Column, b: Column, n: int, weights: dict[str, float] | None) -> Column:
    """Weighted share of a's n-grams that b has, each as often as b has it at most; null where there is none."""
    grams = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), text.JOINT))).otherwise(F.array().cast("array<string>"))

    def weighed(g: Column) -> Column:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        return F.coalesce(F.try_element_at(named, g), F.lit(1.0))

    def of(row: Column) -> Column:
        x, y = row["x"], row["y"]
        kept = F.array_intersect(text.numbered(x), text.numbered(y))
        hits, total = F.size(kept).cast("double"), F.size(x).cast("double")
        if n == 1 and weights:
            hits = F.aggregate(kept, F.lit(0.0), lambda s, g: s + weighed(F.regexp_replace(g, "^[0-9]+:", "")))
            total = F.aggregate(x, F.lit(0.0), lambda s, g: s + weighed(g))
        more = 0.0 if n == 1 else 1.0
        return F.when(total + more > 0, F.nullif((hits + more) / (total + more), F.lit(0.0)))

    return text.bound(F.struct(grams(a).alias("x"), grams(b).alias("y")), of)


def code_score(candidate: Column, reference: Column) -> Column:
    """struct<ngrams, weighted, syntax, flow, score> of two Java sources: BLEU of their tokens, the same with keywords five times
    as heavy, the shares of the reference's part shapes and value flows that the candidate has, and the mean of those of the
    four that there are: a source without flows, or without tokens, has that part null."""

    def of(row: Column) -> Column:
        a, b = row["a"], row["b"]
        parts = {"ngrams": ngram_score(a, b), "weighted": ngram_score(a, b, {k: 5.0 for k in sorted(codematch.KEYWORDS)}), "syntax": row["syntax"], "flow": row["flow"]}
        return F.struct(*[v.alias(k) for k, v in parts.items()], scalars.mean_of_available(*parts.values()).alias("score"))

    tokens = lambda c: text.tokenize(text.normalize_literals(text.strip_comments(c)))
    syntax = codematch.found_share(codematch.shapes_column(candidate), codematch.shapes_column(reference))
    flow = codematch.found_share(codematch.flows_column(candidate), codematch.flows_column(reference))
    return text.bound(F.struct(tokens(candidate).alias("a"), tokens(reference).alias("b"), syntax.alias("syntax"), flow.alias("flow")), of)


def ranked_selection(selected: DataFrame, keys: list[str]) -> DataFrame:
    """selected_tests() with their rank among the key's."""
    order = [c.replace("test_selector", "test_method") for c in ORDERS["pr"]]
    return selected.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_of(order))))


def member_keys(code: Column) -> Column:
    """Keys of a source's members (see java.members)."""

    @F.pandas_udf("array<string>")
    def run(values):
        import pandas as pd

        return pd.Series([None if v is None else [k for k, _ in java.members(v)] for v in values])

    return run(code)


def merged_members(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key, source: members of both tables, those of the first where both have a key."""
    both = first.select(*keys, "key", "source", F.lit(0).alias("__side")).unionByName(second.select(*keys, "key", "source", F.lit(1).alias("__side")))
    return both.groupBy(*keys, "key").agg(F.min_by("source", F.struct("__side", "source")).alias("source"))


def restored_imports(reduced: Column, original: Column) -> Column:
    """reduced with the original's import lines, in their order, in place of its own."""
    pattern = r"(?m)^\s*import\s[^;\n]*;[ \t]*$"
    block = F.array_join(F.array_distinct(F.regexp_extract_all(original, F.lit(pattern), F.lit(0))), "\n")
    bare = F.regexp_replace(reduced, pattern + r"\n?", "")
    package = F.regexp_extract(bare, r"(?m)^\s*package\s[^;\n]*;[ \t]*\n*", 0)
    return F.when(block == "", reduced).otherwise(F.concat(package, block, F.lit("\n"), F.substring(bare, F.length(package) + 1, F.length(bare))))


def filled(rows: DataFrame, templates: DataFrame, names: list[str]) -> DataFrame:
    """rows with text: the template of their kind with ``{name}`` replaced by each named column (null by nothing)."""
    out = F.col("template")
    for name in names:
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return rows.join(templates.select("kind", "template"), "kind", "left").withColumn("text", out).drop("template")

"""COVERAGE.md names only queries that are registered, and beside them only functions that one of them reaches."""

import ast
import os
import re

import gaugewright
from gaugewright import catalog

HERE = os.path.dirname(gaugewright.__file__)


def called():
    """function -> names that its body mentions, by name over all modules but llm."""
    out = {}
    for folder, _, files in os.walk(HERE):
        if os.path.basename(folder) == "llm":
            continue
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file), encoding="utf-8") as f:
                    tree = ast.parse(f.read())
                constants = {t.id: {n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(node.value) if isinstance(n, (ast.Name, ast.Attribute))} for node in tree.body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name)}
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                        names = {n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(node) if isinstance(n, (ast.Name, ast.Attribute))}
                        out.setdefault(node.name, set()).update(names, *(constants[n] for n in names & set(constants)))
    return out


def reached(graph, names):
    seen, waiting = set(), list(names)
    while waiting:
        name = waiting.pop()
        if name not in seen:
            seen.add(name)
            waiting += [n for n in graph.get(name, ()) if n in graph]
    return seen


def test_coverage_table():
    graph = called()
    with open(os.path.join(os.path.dirname(HERE), "COVERAGE.md"), encoding="utf-8") as f:
        rows = [line.split("|")[1:3] for line in f if line.startswith("| ") and not line.startswith(("| Id", "| ---"))]
    wrong = []
    for ids, where in rows:
        queries = re.findall(r"q:(\w+)", where)
        wrong += [(ids.strip(), q, "no query") for q in queries if q not in catalog.QUERIES]
        found = reached(graph, queries)
        named = {name.rpartition(".")[2] for name in re.findall(r"`([\w./]+?)(?:\([^`]*\))?`", where)}
        wrong += [(ids.strip(), name, "not reached") for name in sorted(named) if name in graph and name not in found]
    assert not wrong, "\n".join(map(str, wrong))


def test_every_query_is_named():
    with open(os.path.join(os.path.dirname(HERE), "COVERAGE.md"), encoding="utf-8") as f:
        named = set(re.findall(r"q:(\w+)", f.read()))
    assert not set(catalog.QUERIES) - named

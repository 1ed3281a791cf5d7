"""Symbols of Python sources, in Arrow batches: parsing has no built-in counterpart."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame


def outline(code: str) -> list[tuple[str, str, int, int, str, str]]:
    """(name, kind, first line, last line, parent, names it uses) of each function and class; none if it can't be parsed."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    found = []

    def walk(node: ast.AST, parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                used = sorted({n.id for n in ast.walk(child) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)})
                found.append((child.name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno, child.end_lineno, parent, ",".join(used)))
                walk(child, child.name)
            else:
                walk(child, parent)

    walk(tree, "")
    return found


def symbols(files: DataFrame) -> DataFrame:
    """files: (path, code)."""

    def parse(batches):
        for pdf in batches:
            rows = [(path, *x) for path, code in zip(pdf.path, pdf.code, strict=True) for x in outline(code or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "first_line", "last_line", "parent", "uses"])

    return files.select("path", "code").mapInPandas(parse, "path long, name string, kind string, first_line long, last_line long, parent string, uses string")

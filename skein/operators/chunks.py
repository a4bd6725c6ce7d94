"""Texts cut into chunks for retrieval."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def char_chunks(text: str, size: int = 1500, overlap: int = 200) -> list[tuple[int, int]]:
    """WIN09: (start, end) of pieces of at most ``size`` characters, cut after a line end, semicolon, comma or blank near the end where there is one."""
    out, pos, n = [], 0, len(text)
    while pos < n:
        end = min(pos + size, n)
        if end < n:
            cut = next((i for i in (text.rfind(d, pos + size - overlap, end) for d in "\n;, ") if i > pos), -1)
            end = cut + 1 if cut >= 0 else end
        if text[pos:end].strip():
            out.append((pos, end))
        if end >= n and n - overlap <= pos:
            break
        pos = max(pos + 1, end - overlap) if end < n else n
    return out


def definition_chunks(text: str, longest: int = 400) -> list[tuple[int, int, str]]:
    """WIN10: (first line, last line, kind) of a Python file: imports, functions, classes and what lies between; long ones in parts.

    A file that does not parse is one block in parts.
    """
    lines = text.count("\n") + 1
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        body = []
    spans: list[tuple[int, int, str]] = []
    for node in body:
        kind = "imports" if isinstance(node, (ast.Import, ast.ImportFrom)) else "function" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else "class" if isinstance(node, ast.ClassDef) else "block"
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        if spans and spans[-1][2] == kind and kind in ("imports", "block"):
            spans[-1] = (spans[-1][0], node.end_lineno, kind)
        else:
            spans.append((first, node.end_lineno, kind))
    spans = spans or [(1, lines, "block")]
    return [(a, min(a + longest - 1, last), kind) for first, last, kind in spans for a in range(first, last + 1, longest)]


def chunk_files(df: DataFrame, key: str, path: str, content: str, minified: float = 500) -> DataFrame:
    """WIN08-10: (key, chunk, kind, start, end): by definitions for Python, by characters for minified text, else by lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, p, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not t:
                    continue
                lines = t.count("\n") + 1
                if len(t) / lines > minified:
                    spans = [(a, b, "chars") for a, b in char_chunks(t)]
                elif (p or "").endswith(".py"):
                    spans = definition_chunks(t)
                else:
                    spans = [(a + 1, min(a + 100, lines), "lines") for a in range(0, max(lines - 10, 1), 90)]
                rows += [(k, i, kind, a, b) for i, (a, b, kind) in enumerate(spans)]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], ["key", "chunk", "kind", "start", "end"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, f"key {kind}, chunk int, kind string, start long, end long")
    return out.withColumnRenamed("key", key)

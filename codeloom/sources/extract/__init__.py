"""Symbols and dependencies of source texts, one table function over files."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom import model


@dataclass
class Symbol:
    name: str
    kind: str
    line: int = 0
    column: int = 0
    end_line: int = 0
    end_column: int = 0
    scope: tuple[tuple[str, str], ...] = ()
    modifiers: list[str] = field(default_factory=list)
    signature: str | None = None
    documentation: str | None = None


@dataclass
class Dependency:
    source: str
    target: str
    kind: str
    line: int = 0
    column: int = 0
    conditional: bool = False


def qualified(name: str, scope) -> str:
    return "::".join([*(s[0] for s in scope), name])


def _extract(content: str, language: str) -> tuple[list[Symbol], list[Dependency]]:
    from codeloom.sources.extract import markup, patterns, python

    if language == "python":
        return python.extract(content)
    if language in markup.PARSERS:
        return markup.PARSERS[language](content), []
    return patterns.extract(content, language)


def _run(files: DataFrame, schema, rows_of) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out: list[dict] = []
            for path, content, language in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if content and language:
                    out += rows_of(path, content, language)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("path", "content", "language").mapInArrow(run, schema)


def _symbol_rows(path: str, content: str, language: str) -> list[dict]:
    return [
        {
            "name": s.name, "qualified_name": qualified(s.name, s.scope), "kind": s.kind, "language": language, "file_path": path,
            "start_line": s.line, "start_column": s.column, "end_line": s.end_line, "end_column": s.end_column,
            "scope_chain": [{"name": n, "kind": k} for n, k in s.scope], "modifiers": s.modifiers, "signature": s.signature, "documentation": s.documentation,
        }
        for s in _extract(content, language)[0]
    ]


def _dependency_rows(path: str, content: str, language: str) -> list[dict]:
    return [
        {
            "from_symbol": d.source, "to_symbol": d.target, "relationship_type": d.kind, "file_path": path, "language": language,
            "start_line": d.line, "start_column": d.column, "strength": 0.5 if d.conditional else 1.0, "is_conditional": d.conditional,
        }
        for d in _extract(content, language)[1]
    ]


def symbols(files: DataFrame) -> DataFrame:
    """Symbol rows of (path, content, language); a text that can't be parsed has none."""
    return _run(files, model.SYMBOLS, _symbol_rows)


def dependencies(files: DataFrame) -> DataFrame:
    """Dependency rows of (path, content, language)."""
    return _run(files, model.DEPENDENCIES, _dependency_rows)

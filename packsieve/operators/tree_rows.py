"""Predicate trees that come as rows of JSON: leaves, canonical keys, depths and codes as columns.

A row holds one document as ``predicates.from_json`` reads it. Trees are parsed where
their rows lie, each row by itself, and only what is asked for goes on; keys then
meet in Spark. A row whose document is null or malformed has the code ``malformed``
and nothing else; one nested deeper than the parser goes is malformed too.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsieve.operators import filter_text, predicates
from packsieve.operators.predicates import Field, Refused, Tree


def read(document: str | None) -> Tree | None:
    """The tree, or None for what is malformed."""
    try:
        return predicates.from_json(document) if document is not None else None
    except (Refused, RecursionError):
        return None


def _per_tree(trees: DataFrame, key: str, tree: str, of: Callable[[Tree | None], Iterable[tuple]], columns: str) -> DataFrame:
    """``key`` and the columns of each row that ``of`` makes from a tree."""
    names = [c.strip().split()[0] for c in columns.split(",")]
    kinds = [{"string": pa.string(), "int": pa.int32()}[c.strip().split()[1]] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, document in enumerate(batch.column(1).to_pylist()):
                for row in of(read(document)):
                    at.append(i)
                    rows.append(row)
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], [key, *names])

    return trees.select(F.col(key), F.col(tree)).mapInArrow(run, f"{key} {trees.schema[key].dataType.simpleString()}, {columns}")


def leaves(trees: DataFrame, key: str, tree: str) -> DataFrame:
    """A row for each leaf in preorder: ``key``, pos int, path, field, operator, value (canonical JSON, null for none)."""

    def of(t: Tree | None) -> Iterator[tuple]:
        for pos, (path, x) in enumerate(predicates.leaves(t) if t is not None else ()):
            value = None if x.value is None else predicates.canonical_json(list(x.value) if isinstance(x.value, tuple) else x.value)
            yield pos, ".".join(map(str, path)) or "root", x.field, x.op, value

    return _per_tree(trees, key, tree, of, "pos int, path string, field string, operator string, value string")


def facts(trees: DataFrame, key: str, tree: str, catalog: Mapping[str, Field]) -> DataFrame:
    """A row for each tree: ``key``, code, canonical (JSON), tree_key (its digest), depth int, filter (its text).

    ``code`` is ``malformed``, that of the first leaf which the catalog refuses, or null; a refused tree has no text.
    """

    def of(t: Tree | None) -> Iterator[tuple]:
        if t is None:
            yield "malformed", None, None, None, None
            return
        code = predicates.refusal(t, catalog)
        canonical = predicates.canonical_json(predicates.to_object(predicates.canonical(t)))
        try:
            text = None if code else filter_text.text(t, catalog)
        except Refused as e:
            code, text = e.code, None
        yield code, canonical, predicates.key(t), predicates.depth(t), text

    return _per_tree(trees, key, tree, of, "code string, canonical string, tree_key string, depth int, filter string")


def alike(facts_: DataFrame, key: str) -> DataFrame:
    """Trees of one canonical key kept once: tree_key, the smallest ``key``, how many there are, the smallest depth."""
    return facts_.where("tree_key is not null").groupBy("tree_key").agg(F.min(key).alias(key), F.count("*").alias("trees"), F.min("depth").alias("depth"))


def document(expression: Column) -> Column:
    """An expression's JSON as a document."""
    return F.concat(F.lit('{"ir_schema_version":"1.0","scope":"packet","expression":'), expression, F.lit("}"))


def predicate(field: Column | str, operator: str, value: Column | None = None) -> Column:
    """A leaf's JSON; ``value`` is JSON already."""
    name = F.lit(field) if isinstance(field, str) else field
    parts = [F.lit('{"kind":"predicate","field":"'), name, F.lit(f'","operator":"{operator}"')]
    return F.concat(*parts, *([] if value is None else [F.lit(',"value":'), value]), F.lit("}"))


def group(kind: str, *children: Column) -> Column:
    """A group's JSON: ``all`` or ``any``."""
    inside = functools.reduce(lambda a, b: F.concat(a, F.lit(","), b), children)
    return F.concat(F.lit(f'{{"kind":"{kind}","children":['), inside, F.lit("]}"))


def negated(child: Column) -> Column:
    return F.concat(F.lit('{"kind":"not","child":'), child, F.lit("}"))

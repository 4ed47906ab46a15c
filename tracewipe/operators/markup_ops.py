"""Markup operators over columns: scrubbing pages by the SVG rules, and the office XML rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .formats import svg
from .formats.markup import RULES, blank_text, leaves_document, neutral_css, remove_elements, scrub_attributes

COUNTS = ", ".join(f"{r} int" for r in svg.REASONS)


def _bytes(v) -> bytes:
    v = v.as_py()
    return b"" if v is None else v.encode() if isinstance(v, str) else v


def _scrub(emit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [svg.scrub(_bytes(x)) for x in b.column(0)]
            cols = [*b.columns[1:], *(pa.array([n[r] for _, n in done], pa.int32()) for r in svg.REASONS)]
            names = [*b.schema.names[1:], *svg.REASONS]
            if emit:
                cols.append(pa.array([out.decode("utf-8", "replace") for out, _ in done], pa.string()))
                names.append("cleaned")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def scrub_markup(df: DataFrame, column: str, keep: list[str], emit: bool = True) -> DataFrame:
    """``keep`` columns, the number of things dropped by reason and, if asked, the ``cleaned`` markup."""
    prepare(df.sparkSession)
    kept = df.select(F.col(column).alias("_markup"), *keep)
    types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[1:])
    return kept.mapInArrow(_scrub(emit), f"{types}, {COUNTS}" + ", cleaned string" * emit)


def _apply(work, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [work(_bytes(x)) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array([d[i] for d in done], t) for i, t in enumerate(types))], [*b.schema.names[1:], *names])

    return run


def _mapped(df: DataFrame, column: str, keep: list[str], work, schema: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    prepare(df.sparkSession)
    kept = df.select(F.col(column).alias("_in"), *keep)
    types = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[1:]), *(f"{n} {t}" for n, t, _ in schema)])
    return kept.mapInArrow(_apply(work, [n for n, _, _ in schema], [t for _, _, t in schema]), types)


def scrub_xml_attributes(df: DataFrame, column: str, keep: list[str], rules=RULES) -> DataFrame:
    """``keep``, blanked, removed, cleaned."""

    def work(data: bytes):
        out, blanked, removed = scrub_attributes(data, rules)
        return blanked, removed, out.decode("utf-8", "replace")

    return _mapped(df, column, keep, work, [("blanked", "int", pa.int32()), ("removed", "int", pa.int32()), ("cleaned", "string", pa.string())])


def remove_xml_elements(df: DataFrame, column: str, keep: list[str], names: list[str]) -> DataFrame:
    drop = frozenset(n.lower().encode() for n in names)

    def work(data: bytes):
        out, n = remove_elements(data, drop)
        return n, out.decode("utf-8", "replace")

    return _mapped(df, column, keep, work, [("removed", "int", pa.int32()), ("cleaned", "string", pa.string())])


def blank_xml_text(df: DataFrame, column: str, keep: list[str], names: list[str]) -> DataFrame:
    inside = frozenset(n.lower().encode() for n in names)

    def work(data: bytes):
        out, n = blank_text(data, inside)
        return n, out.decode("utf-8", "replace")

    return _mapped(df, column, keep, work, [("blanked", "int", pa.int32()), ("cleaned", "string", pa.string())])


def neutral_styles(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    def work(data: bytes):
        out, n = neutral_css(data)
        return n, out.decode("utf-8", "replace")

    return _mapped(df, column, keep, work, [("external", "int", pa.int32()), ("cleaned", "string", pa.string())])


def outside_references(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    return _mapped(df, column, keep, lambda data: (leaves_document(data),), [("external", "boolean", pa.bool_())])

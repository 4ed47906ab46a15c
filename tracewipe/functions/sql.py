"""The operators as SQL functions.

``register(spark)`` adds, under a prefix: ``detect_format(content)``, ``inspect(content)`` and
``scrub(content)`` (a struct with the report, and ``data`` for the latter), ``scrub_markup(text)``,
``scrub_xml(text)``, ``wash(content, strength)`` and ``to_png(content, max_edge, max_bytes)`` (null where
a picture cannot be decoded or does not fit), and the table function ``findings(content)``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators import pixels
from ..operators.detect import detect_format, format_of, needs_probe
from ..operators.formats import svg
from ..operators.formats.markup import scrub_attributes
from ..operators.model import NONE, REPORT, Policy, ScrubError, error_row, report_row
from ..operators.scrub import scrub_bytes
from ..session import prepare

WITH_DATA = T.StructType([*REPORT.fields, T.StructField("data", T.BinaryType())])


def _report(data: bytes | None, policy: Policy, emit: bool) -> dict | None:
    if data is None:
        return None
    try:
        out, report = scrub_bytes(data, policy)
        row = report_row(report)
    except ScrubError as e:
        out, row = None, error_row(e, format_of(data), len(data))
    if emit:
        row["data"] = None if row["assurance"] in (None, NONE) else out
    return row


def _each(work, kind: T.DataType):
    arrow = to_arrow_type(kind)

    @F.arrow_udf(returnType=kind)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([work(v) for v in column.to_pylist()], arrow)

    return run


def _markup(text: str | None) -> str | None:
    return None if text is None else svg.scrub(text.encode())[0].decode("utf-8", "replace")


def _xml(text: str | None) -> str | None:
    return None if text is None else scrub_attributes(text.encode())[0].decode("utf-8", "replace")


def _picture(work):
    """``work`` on each row's values; null where the content is null or the picture is refused."""

    @F.arrow_udf(returnType=T.BinaryType())
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for content, *rest in zip(*(c.to_pylist() for c in columns), strict=True):
            try:
                out.append(None if content is None else work(content, *rest))
            except ScrubError:
                out.append(None)
        return pa.array(out, pa.binary())

    return run


class _Findings:
    def eval(self, content: bytes):
        row = _report(content, Policy(), False) or {"removed": []}
        for r in row["removed"]:
            yield r["ord"], r["kind"], r["location"], r["bytes"]


def _sql_of(spark: SparkSession, expression: Column) -> str:
    """The SQL text of an expression over a binary column ``content``."""
    one = spark.createDataFrame([], "content binary").select(expression.alias("x"))
    return one._jdf.queryExecution().analyzed().expressions().head().child().sql()


def _detection(spark: SparkSession, prefix: str) -> None:
    """``detect_format`` as an SQL function that is inlined: leading bytes decide in generated code, only files that need it are probed in Python."""
    content = F.col("content")
    spark.udf.register(f"{prefix}probe_format", _each(lambda d: None if d is None else format_of(d), T.StringType()))
    body = f"coalesce({_sql_of(spark, detect_format(content))}, {prefix}probe_format(CASE WHEN {_sql_of(spark, needs_probe(content))} THEN content END))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}detect_format(content BINARY) RETURNS STRING RETURN {body}")


def register(spark: SparkSession, prefix: str = "tw_", policy: Policy = Policy()) -> None:
    prepare(spark)
    _detection(spark, prefix)
    for name, f in (
        ("inspect", _each(lambda d: _report(d, policy, False), REPORT)),
        ("scrub", _each(lambda d: _report(d, policy, True), WITH_DATA)), ("scrub_markup", _each(_markup, T.StringType())), ("scrub_xml", _each(_xml, T.StringType())),
    ):
        spark.udf.register(prefix + name, f)
    spark.udf.register(prefix + "wash", _picture(lambda content, strength: pixels.wash(content, strength or "medium")[0]))
    spark.udf.register(prefix + "to_png", _picture(pixels.to_png))
    spark.udtf.register(f"{prefix}findings", F.udtf(_Findings, returnType="ord int, kind string, location string, bytes bigint"))

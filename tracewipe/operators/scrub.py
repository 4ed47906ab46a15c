"""The scrub operator: one row per file in, cleaned bytes and a report out.

Files are independent, so the plan is a single map: no shuffle, and a file that cannot be read becomes
a row with ``error``. ``inspect`` asks for the report alone and never builds an output column.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import prepare
from .detect import format_of
from .formats import gif, heif, jpeg, office, pdf, png, raw, svg, tiff, webp, xmp
from .model import BEST_EFFORT, NONE, REPORT, Policy, Report, ScrubError, error_row, report_row

CLEANERS = {
    "JPEG": jpeg.clean, "PNG": png.clean, "WebP": webp.clean, "HEIF": heif.clean, "AVIF": heif.clean, "GIF": gif.clean, "TIFF": tiff.clean, "SVG": svg.clean,
    "XMP sidecar": xmp.clean, "camera raw": raw.clean, "PDF": pdf.clean,
}
NESTING = frozenset(("OOXML", "OpenDocument"))
HELD = 64 << 20
LEFT_ALONE = {"video": "VIDEO_NOT_CLEANED", "audio": "AUDIO_NOT_CLEANED"}


def scrub_bytes(data: bytes, policy: Policy = Policy(), depth: int = 0) -> tuple[bytes, Report]:
    """One file's cleaned bytes and report; ``ScrubError`` where it cannot be read."""
    if policy.max_bytes is not None and len(data) > policy.max_bytes:
        raise ScrubError("too_large", "file", f"{len(data)} bytes, the limit is {policy.max_bytes}")
    kind = format_of(data)
    report = Report(kind, len(data))
    if kind in NESTING and depth >= office.DEPTH:
        report.weaken(BEST_EFFORT)
        report.warnings.append("NESTED_TOO_DEEP")
        out = data
    elif kind in NESTING:
        out = office.clean(data, policy, report, depth, lambda d, k: scrub_bytes(d, policy, k))
    elif kind in CLEANERS:
        try:
            out = CLEANERS[kind](data, policy, report)
        except (AttributeError, LookupError, OverflowError, RecursionError, TypeError, ValueError, struct.error) as e:
            raise ScrubError("malformed", kind, f"{type(e).__name__} while reading") from e
    else:
        report.weaken(NONE)
        report.warnings.append(LEFT_ALONE.get(kind, "FORMAT_NOT_CLEANED"))
        out = data
    report.output_len = len(out)
    return out, report


def verified(data: bytes, policy: Policy = Policy()) -> tuple[bytes, Report]:
    """As ``scrub_bytes``, checked: the same again from the same bytes, and nothing to do on the output."""
    out, report = scrub_bytes(data, policy)
    if report.assurance != NONE:
        report.verification = (scrub_bytes(out, policy)[0] == out, scrub_bytes(data, policy)[0] == out)
    return out, report


def _run(policy: Policy, verify: bool, emit: bool, schema: pa.Schema, keep: int):
    work = verified if verify else scrub_bytes

    def one(data: bytes | None) -> tuple[dict, bytes | None]:
        if data is None:
            return error_row(ScrubError("io", "file", "no content"), None, 0), None
        try:
            out, report = work(data, policy)
        except ScrubError as e:
            return error_row(e, format_of(data), len(data)), None
        return report_row(report), None if report.assurance == NONE else out

    def made(b: pa.RecordBatch, lo: int, rows: list[dict], outs: list[bytes | None]) -> pa.RecordBatch:
        columns = [b.column(1 + i).slice(lo, len(rows)).cast(schema.field(i).type) for i in range(keep)]
        columns += [pa.array([r[f.name] for r in rows], f.type) for f in schema if f.name in REPORT.fieldNames()]
        if emit:
            columns.append(pa.array(outs, schema.field(len(schema) - 1).type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, rows, outs, held = 0, [], [], 0
            for i, data in enumerate(b.column(0)):
                row, out = one(data.as_py())
                rows.append(row), outs.append(out if emit else None)
                held += len(outs[-1] or b"")
                if held >= HELD:  # outputs leave by bytes, not by rows
                    yield made(b, lo, rows, outs)
                    lo, rows, outs, held = i + 1, [], [], 0
            if rows:
                yield made(b, lo, rows, outs)

    return run


def scrub(files: DataFrame, keep: list[str], policy: Policy = Policy(), verify: bool = False, emit: bool = True) -> DataFrame:
    """``keep`` columns of each row of ``files`` with the report of its ``content`` and, if asked, ``data``.

    ``data`` is null where nothing was cleaned (assurance none) or the file could not be read.
    """
    prepare(files.sparkSession)
    kept = files.select("content", *keep)
    schema = T.StructType([*kept.schema.fields[1:], *REPORT.fields, *([T.StructField("data", T.BinaryType())] if emit else [])])
    return kept.mapInArrow(_run(policy, verify, emit, to_arrow_schema(schema), len(keep)), schema)


def inspect(files: DataFrame, keep: list[str], policy: Policy = Policy()) -> DataFrame:
    """The report alone."""
    return scrub(files, keep, policy, emit=False)

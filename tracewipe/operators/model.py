"""The data model: one report per file, its Spark schema, and the dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMPLETE, BEST_EFFORT, NONE = 0, 1, 2
ASSURANCE = ("complete", "best effort", "none")

# The finding kinds in their order, and the names of formats.
KINDS = (
    "EXIF", "XMP", "IPTC", "maker note", "thumbnail", "colour profile", "comment", "trailing data", "unrecognised structure",
    "document info", "author identity", "timestamp", "revision identifiers", "archive entry metadata", "custom property",
)
(
    EXIF, XMP, IPTC, MAKER_NOTE, THUMBNAIL, PROFILE, COMMENT, TRAILER, UNKNOWN,
    DOCUMENT, AUTHOR, TIMESTAMP, REVISION, ENTRY, CUSTOM,
) = KINDS
FORMATS = (
    "JPEG", "PNG", "WebP", "HEIF", "AVIF", "GIF", "TIFF", "SVG", "XMP sidecar", "camera raw", "video", "audio", "PDF", "OOXML", "OpenDocument", "ZIP", "unknown format",
)


@dataclass(frozen=True)
class Policy:
    """What may stay. The default keeps nothing that is optional."""

    keep_orientation: bool = False
    keep_profile: bool = False
    recurse: bool = True
    max_bytes: int | None = 256 << 20


class ScrubError(Exception):
    """A file that cannot be cleaned; becomes a row's ``error``, never a failed job."""

    def __init__(self, cls: str, format: str, detail: str):
        super().__init__(f"{format}: {detail}")
        self.cls, self.format, self.detail = cls, format, detail


def malformed(format: str, detail: str) -> ScrubError:
    return ScrubError("malformed", format, detail)


@dataclass
class Report:
    """What happened to one file; operators may only weaken ``assurance``."""

    format: str
    input_len: int
    assurance: int = COMPLETE
    removed: list[tuple[str, str, int]] = field(default_factory=list)
    retained: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    found_location: bool = False
    output_len: int = 0
    verification: tuple[bool, bool] | None = None

    def drop(self, kind: str, location: str, size: int) -> None:
        self.removed.append((kind, location, size))

    def retain(self, what: str, reveals: str) -> None:
        self.retained.setdefault(what, reveals)

    def retain_profile(self) -> None:
        self.retain("ICC_PROFILE", "device, software and creation date of the colour profile")

    def weaken(self, assurance: int) -> None:
        self.assurance = max(self.assurance, assurance)

    def absorb(self, path: str, child: Report) -> None:
        """Takes in the report of a part of this file."""
        self.removed += [(kind, f"{path} → {where}", n) for kind, where, n in child.removed]
        self.warnings += [f"{path}: {w}" for w in child.warnings]
        for what, reveals in child.retained.items():
            self.retain(what, reveals)
        self.found_location |= child.found_location
        self.weaken(child.assurance)


REMOVED = T.ArrayType(T.StructType().add("ord", T.IntegerType()).add("kind", T.StringType()).add("location", T.StringType()).add("bytes", T.LongType()))
RETAINED = T.ArrayType(T.StructType().add("what", T.StringType()).add("reveals", T.StringType()))
VERIFICATION = T.StructType().add("output_reinspected_clean", T.BooleanType()).add("deterministic", T.BooleanType()).add("passed", T.BooleanType())
ERROR = T.StructType().add("class", T.StringType()).add("format", T.StringType()).add("detail", T.StringType())
REPORT = (
    T.StructType()
    .add("format", T.StringType()).add("assurance", T.ByteType()).add("found_location", T.BooleanType()).add("input_len", T.LongType()).add("output_len", T.LongType())
    .add("removed", REMOVED).add("retained", RETAINED).add("warnings", T.ArrayType(T.StringType()))
    .add("verification", VERIFICATION).add("error", ERROR)
)


def report_row(r: Report) -> dict:
    v = r.verification
    return {
        "format": r.format, "assurance": r.assurance, "found_location": r.found_location, "input_len": r.input_len, "output_len": r.output_len,
        "removed": [{"ord": i, "kind": k, "location": w, "bytes": n} for i, (k, w, n) in enumerate(r.removed)],
        "retained": [{"what": w, "reveals": x} for w, x in r.retained.items()], "warnings": list(r.warnings),
        "verification": None if v is None else {"output_reinspected_clean": v[0], "deterministic": v[1], "passed": v[0] and v[1]}, "error": None,
    }


def error_row(e: ScrubError, format: str | None, size: int) -> dict:
    return {
        "format": format, "assurance": None, "found_location": None, "input_len": size, "output_len": None, "removed": [], "retained": [], "warnings": [],
        "verification": None, "error": {"class": e.cls, "format": e.format, "detail": e.detail},
    }


def dim_kind(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(KINDS)), "kind_ord int, kind string")


def dim_format(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FORMATS)), "format_ord int, format string")


def dim_assurance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ASSURANCE)), "assurance int, label string")

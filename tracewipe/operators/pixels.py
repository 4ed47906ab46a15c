"""Lossy pixel operators on PNG rasters: fingerprint reduction and bounded re-encoding, in numpy.

There is no JPEG or WebP codec here, so those decode to an ``unsupported`` error, and washed pictures
are PNGs. Noise is drawn from a seed of the content, so runs agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import prepare
from .formats import png
from .model import REPORT, Policy, ScrubError, malformed, report_row
from .scrub import scrub_bytes, verified

MOST_PIXELS = 120_000_000
LEAST_EDGE = 16
NOISE_SPREAD = 1.7


@dataclass(frozen=True)
class Strength:
    scale: float
    radius: float
    amount: float
    sigma: float
    quality: int


# Fixed values
STRENGTHS = {"light": Strength(0.90, 0.8, 0.45, 0.8, 92), "medium": Strength(0.70, 1.3, 0.70, 1.6, 85), "strong": Strength(0.50, 2.0, 0.90, 2.6, 78)}
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The pixels (height, width, channels) behind PNG row filters.

    A pixel needs the ones to its left, above and between, so all pixels of one anti-diagonal are done
    together: width + height steps, whatever the filters.
    """
    h, w, n = lines.shape
    if not kinds.any():
        return lines.copy()
    out = np.zeros_like(lines)
    last, before = np.zeros((2, h + 1, n), np.int16)  # of the last two diagonals, by row; the first is the one above the picture
    for t in range(w + h - 1):
        lo, hi = max(0, t - w + 1), min(h, t + 1)
        y = np.arange(lo, hi)
        x, kind = t - y, kinds[lo:hi, None]
        left, above, corner = last[lo + 1 : hi + 1], last[lo:hi], before[lo:hi]
        a, b, c = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)
        now = (lines[y, x] + guess) & 255
        out[y, x] = now
        last, before = before, last
        last[lo + 1 : hi + 1] = now
    return out


def decode(data: bytes, most: int = MOST_PIXELS) -> np.ndarray:
    """RGB (height, width, 3) uint8 of an 8-bit PNG that is not interlaced; alpha is dropped."""
    if data[:8] != png.MAGIC:
        raise ScrubError("unsupported", "image", "only PNG pictures can be decoded")
    head, palette, body = None, None, []
    for tag, part, _ in png.chunks(data):
        if tag == b"IHDR":
            head = part
        elif tag == b"PLTE":
            palette = np.frombuffer(part[: len(part) // 3 * 3], np.uint8).reshape(-1, 3)
        elif tag == b"IDAT":
            body.append(part)
    if head is None or len(head) < 13:
        raise malformed("PNG", "there is no header chunk")
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    if w * h > most or not w or not h:
        raise ScrubError("too_large", "PNG", f"{w} x {h} pixels")
    if head[8] != 8 or head[9] not in _CHANNELS or head[12]:
        raise ScrubError("unsupported", "PNG", "only 8-bit pictures that are not interlaced")
    n = _CHANNELS[head[9]]
    size = h * (1 + w * n)
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), size)
    except zlib.error as e:
        raise malformed("PNG", str(e)) from e
    if len(raw) < size:
        raise malformed("PNG", "there are too few pixels")
    rows = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * n)
    if rows[:, 0].max() > 4:
        raise malformed("PNG", f"row filter {rows[:, 0].max()}")
    out = unfiltered(rows[:, 0], rows[:, 1:].reshape(h, w, n))
    if head[9] == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise malformed("PNG", "a palette index has no colour")
        return palette[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, axis=2) if n < 3 else out[:, :, :3].copy()


def encode(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = rgb.reshape(h, 3 * w)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02\0\0\0"
    return png.MAGIC + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + png.chunk(b"IEND", b"")


def soft_threshold(value: Column, threshold: Column | float) -> Column:
    """``value`` drawn towards 0 by ``threshold``, as a Spark expression."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return F.when(F.abs(value) <= t, F.lit(0.0)).when(value > 0, value - t).otherwise(value + t)


def _soft(v: np.ndarray, t: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def detail_strength(detail: np.ndarray) -> float:
    """Root mean square."""
    return float(np.sqrt((detail**2).mean()))


def box_blur(plane: np.ndarray, radius: int) -> np.ndarray:
    """Across, down, across, down; edges repeat, so every mean is over 2 radius + 1 values."""
    for axis in (1, 0, 1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius + 1, radius)
        total = np.cumsum(np.pad(plane, pad, mode="edge"), axis=axis, dtype=np.float64)
        k, n = 2 * radius + 1, plane.shape[axis]
        plane = (np.take(total, range(k, k + n), axis=axis) - np.take(total, range(n), axis=axis)) / k
    return plane


def shrink(rgb: np.ndarray, radius: float, amount: float) -> np.ndarray:
    """Detail below a threshold of its own strength is taken away, per channel."""
    if radius <= 0 or amount <= 0 or min(rgb.shape[:2]) < 3:
        return rgb
    amount, out = min(amount, 1.0), np.empty_like(rgb)
    for c in range(3):
        plane = rgb[:, :, c].astype(np.float64)
        smooth = box_blur(plane, max(1, round(radius)))
        detail = plane - smooth
        kept = smooth + _soft(detail, detail_strength(detail) * amount * 2)
        out[:, :, c] = np.clip(plane * (1 - amount) + kept * amount, 0, 255)
    return out


def _lanczos(n: int, m: int, a: int = 3) -> np.ndarray:
    """The (m, n) matrix that samples n values down to m."""
    ratio = n / m
    width = max(1.0, ratio)
    centre = (np.arange(m) + 0.5) * ratio - 0.5
    x = (np.arange(n)[None] - centre[:, None]) / width
    w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    rows = np.tensordot(_lanczos(rgb.shape[0], h), rgb.astype(np.float64), axes=(1, 0))
    out = np.einsum("wx,hxc->hwc", _lanczos(rgb.shape[1], w), rows)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def fit_edge(rgb: np.ndarray, edge: int) -> np.ndarray:
    h, w = rgb.shape[:2]
    k = edge / max(h, w)
    return rgb if k >= 1 else resize(rgb, max(1, round(w * k)), max(1, round(h * k)))


def noisy(rgb: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    """Triangular noise around 0, the same for the same seed."""
    if sigma <= 0:
        return rgb
    rng = np.random.default_rng(seed)
    u = rng.random(rgb.shape) + rng.random(rgb.shape) - 1
    return np.clip(rgb + u * sigma * NOISE_SPREAD, 0, 255).astype(np.uint8)


def wash(data: bytes, strength: str = "medium", most: int = MOST_PIXELS) -> tuple[bytes, dict]:
    """Denoise, scale down, add noise, encode; and what was done. Pictures are written as PNG, so ``quality`` is null."""
    s, rgb = STRENGTHS[strength], decode(data, most)
    h, w = rgb.shape[:2]
    nw, nh = max(1, round(w * s.scale)), max(1, round(h * s.scale))
    out = encode(noisy(resize(shrink(rgb, s.radius, s.amount), nw, nh), s.sigma, zlib.crc32(data)))
    return out, {"orig_w": w, "orig_h": h, "new_w": nw, "new_h": nh, "output_len": len(out), "quality": None}


def to_png(data: bytes, max_edge: int | None = None, max_bytes: int | None = None, most: int = MOST_PIXELS) -> bytes:
    """Re-encoded, no longer than ``max_edge`` and, by a binary search for the edge, within ``max_bytes``."""
    base = decode(data, most)
    if max_edge:
        base = fit_edge(base, max_edge)
    out = encode(base)
    if max_bytes is None or len(out) <= max_bytes:
        return out
    longest = max(base.shape[:2])
    lo, hi, best = min(LEAST_EDGE, longest), longest - 1, None
    while lo <= hi:
        mid = (lo + hi) // 2
        out = encode(fit_edge(base, mid))
        if len(out) <= max_bytes:
            best, lo = out, mid + 1
        else:
            hi = mid - 1
    if best is None:
        raise ScrubError("budget", "PNG", f"{len(out)} bytes at the smallest size, the limit is {max_bytes}")
    return best


WASH = "orig_w int, orig_h int, new_w int, new_h int, output_len long, quality int"


def _wash(strength: str, keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in WASH.split(", ")]
        for b in batches:
            done, datas, errors = [], [], []
            for x in b.column(0):
                try:
                    if (data := x.as_py()) is None:
                        raise ScrubError("io", "image", "no content")
                    out, report = wash(data, strength)
                    datas.append(out), done.append(report), errors.append(None)
                except ScrubError as e:
                    datas.append(None), done.append({}), errors.append(e.cls)
            cols = [pa.array([d.get(n) for d in done], pa.int64() if t == "long" else pa.int32()) for n, t in fields]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(1 + i) for i in range(keep)), *cols, pa.array(errors, pa.string()), pa.array(datas, pa.binary())], [*names, *(n for n, _ in fields), "error_class", "data"]
            )

    return run


def wash_files(files: DataFrame, keep: list[str], strength: str = "medium") -> DataFrame:
    """``keep`` columns with the wash report of ``content``, an error class or the washed ``data``."""
    prepare(files.sparkSession)
    kept = files.select("content", *keep)
    types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[1:])
    return kept.mapInArrow(_wash(strength, len(keep), keep), f"{types}, {WASH}, error_class string, data binary")


def _each(work, keep: int, schema: pa.Schema):
    """``work`` on each content: its values for the schema's last columns, or the class of its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names[keep:-1]
        for b in batches:
            rows = []
            for x in b.column(0):
                try:
                    if (data := x.as_py()) is None:
                        raise ScrubError("io", "image", "no content")
                    rows.append({**work(data), "error_class": None})
                except ScrubError as e:
                    rows.append({"error_class": e.cls})
            kept = [b.column(1 + i).cast(schema.field(i).type) for i in range(keep)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r.get(n) for r in rows], schema.field(n).type) for n in (*names, "error_class"))], schema=schema)

    return run


def _mapped(files: DataFrame, keep: list[str], fields: list[T.StructField], work) -> DataFrame:
    prepare(files.sparkSession)
    kept = files.select("content", *keep)
    schema = T.StructType([*kept.schema.fields[1:], *fields, T.StructField("error_class", T.StringType())])
    return kept.mapInArrow(_each(work, len(keep), to_arrow_schema(schema)), schema)


def to_png_files(files: DataFrame, keep: list[str], max_edge: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``keep`` columns with each ``content`` as a PNG ``data`` within the budget, its ``width`` and ``height``, or an error class."""

    def work(content: bytes) -> dict:
        out = to_png(content, max_edge, max_bytes)
        return {"width": int.from_bytes(out[16:20], "big"), "height": int.from_bytes(out[20:24], "big"), "data": out}

    return _mapped(files, keep, [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType())], work)


def residuals(files: DataFrame, keep: list[str], radius: int) -> DataFrame:
    """``keep`` columns with ``rms``: the strength of each picture's detail beyond a blur, by channel, which ``shrink`` scales its threshold by."""

    def work(content: bytes) -> dict:
        rgb = decode(content).astype(np.float64)
        return {"rms": [detail_strength(rgb[:, :, c] - box_blur(rgb[:, :, c], radius)) for c in range(3)]}

    return _mapped(files, keep, [T.StructField("rms", T.ArrayType(T.DoubleType()))], work)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays of numbers of one length (two patterns), as a Spark expression; null where one is constant."""

    def centred(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double")) / F.size(v)
        return F.transform(v, lambda x: x.cast("double") - mean)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)

    x, y = centred(a), centred(b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(size > 0, dot(x, y) / size)


def wash_and_scrub(files: DataFrame, keep: list[str], strength: str = "medium", policy: Policy = Policy()) -> DataFrame:
    """Washes each picture and scrubs what comes out, in one map.

    The report lists what the original held (findings, retained, place, input length) beside the format,
    output length, assurance and verification of the washed file; ``data`` is the washed and scrubbed file.
    """

    def work(content: bytes) -> dict:
        washed, _ = wash(content, strength)
        out, after = verified(washed, policy)
        before = scrub_bytes(content, policy)[1]
        row, first = report_row(after), report_row(before)
        row |= {k: first[k] for k in ("removed", "retained", "warnings", "input_len")}
        row["found_location"] = before.found_location or after.found_location
        return row | {"data": out}

    return _mapped(files, keep, [*REPORT.fields, T.StructField("data", T.BinaryType())], work)


# What the decoder is offered, by media type and by extension.
WASHABLE_TYPES = ("image/jpeg", "image/png", "image/webp")
WASHABLE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


def washable_type(mime: Column) -> Column:
    """Whether washing is offered for a media type; not for null."""
    return F.coalesce(mime.isin(*WASHABLE_TYPES), F.lit(False))


def washable_name(path: Column) -> Column:
    """Whether washing is offered for a file name, letter case aside; not for null."""
    return F.coalesce(reduce(or_, (F.lower(path).endswith(e) for e in WASHABLE_EXTENSIONS)), F.lit(False))


def washable(format: Column) -> Column:
    """Either "ok" or why pictures of a format are not washed."""
    return (
        F.when(format.isin("JPEG", "PNG", "WebP", "TIFF", "GIF"), "ok").when(format == "camera raw", "raw_must_be_developed")
        .when(format.isin("HEIF", "AVIF"), "no_decoder").otherwise("not_an_image")
    )

"""Where cleaned files go: names, and an atomic write for each."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import file_extension, folder
from ..operators.report import writable
from ..session import prepare

STEM = 24
ROLLS, TRIES = 16, 8
ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"


def clean_name(path: Column, suffix: str = "clean") -> Column:
    """photo.jpg becomes photo.clean.jpg."""
    ext = file_extension(path)
    return F.when(ext.isNull(), F.concat(path, F.lit(f".{suffix}"))).otherwise(F.regexp_replace(path, r"\.([^./]*)$", f".{suffix}.$1"))


def random_name(path: Column, seed: Column, attempt: int = 0) -> Column:
    """A name of ``STEM`` base32 letters beside the file, the extension in lower case.

    The letters come from a hash of ``seed``; give a secret, unique one to each run (for example
    ``uuid()`` written down once), so that names say nothing and a retried task finds its own again.
    """
    hash = F.sha2(F.concat_ws("|", seed.cast("string"), path, *([F.lit(str(attempt))] if attempt else [])), 256)
    letters = [F.substring(F.lit(ALPHABET), (F.conv(F.substring(hash, 2 * i + 1, 2), 16, 10).cast("int").bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(STEM)]
    ext = F.lower(file_extension(path))
    return F.concat(folder(path), F.lit("/"), *letters, F.when(ext.isNull(), "").otherwise(F.concat(F.lit("."), ext)))


def random_names(path: Column, seed: Column, rolls: int = ROLLS) -> Column:
    """The names to try one after another, should some be taken."""
    return F.array(*[random_name(path, seed, i) for i in range(rolls)])


def destination(path: Column, mode: str = "suffix", suffix: str = "clean", out: Column | None = None, seed: Column | None = None) -> Column:
    if mode == "in_place":
        return path
    if mode == "out" and out is not None:
        return out
    if mode == "random" and seed is not None:
        return random_names(path, seed)
    if mode != "suffix":
        raise ValueError(f"mode {mode!r} lacks what it needs")
    return clean_name(path, suffix)


def washed_name(path: Column, washed: Column, extension: str = "png") -> Column:
    """The name with the washed picture's extension, where it was washed."""
    return F.when(washed, F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(f".{extension}"))).otherwise(path)


class Taken(Exception):
    """A target that must be new is there."""


def _same(path: str, data: bytes) -> bool:
    with open(path, "rb") as f:
        return os.fstat(f.fileno()).st_size == len(data) and f.read() == data


def _put_local(path: str, data: bytes, exclusive: bool) -> None:
    """A file for its owner alone, on disk before it gets its name; the name is taken in one step."""
    for left in range(TRIES, 0, -1):
        part = f"{os.path.dirname(path) or '.'}/.{uuid.uuid4().hex}.part"
        try:
            fd = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
            break
        except FileExistsError:
            if left == 1:
                raise
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if not exclusive:
            os.replace(part, path)
            return
        try:
            os.link(part, path)
        except FileExistsError:
            if not _same(path, data):  # a retried task finds what it wrote before
                raise Taken(path) from None
    finally:
        with suppress(FileNotFoundError):
            os.unlink(part)


def _put_remote(files: pafs.FileSystem, path: str, data: bytes, exclusive: bool) -> None:
    """As ``_put_local`` as far as the file system goes: a look before the data is written and one before its move, which most refuse onto a file."""

    def there() -> bool:
        """Whether a retried task finds what it wrote before; a file with other bytes is an error."""
        if not exclusive or files.get_file_info(path).type == pafs.FileType.NotFound:
            return False
        with files.open_input_stream(path) as f:
            if f.read(len(data) + 1) == data:
                return True
        raise Taken(path)

    if there():
        return
    part = f"{path}.{uuid.uuid4().hex}.part"
    moved = False
    try:
        with files.open_output_stream(part) as f:
            f.write(data)
        if not there():
            files.move(part, path)
            moved = True
    finally:
        if not moved:
            with suppress(OSError):
                files.delete_file(part)


def _put(exclusive: bool, stop: bool):
    def one(targets: list[str], data: bytes) -> tuple[str, str | None]:
        """Where the data went, or the last target tried and why it could not."""
        why = "no target"
        for path in targets:
            uri = path if "://" in path else path.replace("file:/", "/", 1)
            files, at = pafs.FileSystem.from_uri(uri)
            try:
                if isinstance(files, pafs.LocalFileSystem):
                    _put_local(at, data, exclusive)
                else:
                    _put_remote(files, at, data, exclusive)
                return path, None
            except Taken:
                why = "exists"
            except OSError as e:
                return path, f"{type(e).__name__}: {e.strerror or e}"
        return (targets or [""])[-1], why

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for targets, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_py()
                path, error = one(targets, data)
                if error and stop:
                    raise OSError(f"{path}: {error}")
                rows.append((path, None if error else len(data), error))
            paths, sizes, errors = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["path", "bytes", "error"])

    return run


def export(cleaned: DataFrame, target: Column, replace: bool = False, stop: bool = False) -> DataFrame:
    """Writes ``data`` of each cleaned row to ``target`` and gives (path, bytes, error); act on it once.

    ``target`` is a path, or an array of paths to try in order. Each file is written under another name
    and moved into place, so readers see all of it or none; what is there already is only written over
    with ``replace``, else it is the error ``exists``. A retried task that finds its own bytes is content.
    With ``stop`` the first error ends the job; files before it stay. Rows without an output are left out.
    """
    prepare(cleaned.sparkSession)
    rows = writable(cleaned).filter("data is not null").select(target.alias("target"), "data")
    if not isinstance(rows.schema["target"].dataType, ArrayType):
        rows = rows.select(F.array("target").alias("target"), "data")
    return rows.mapInArrow(_put(not replace, stop), "path string, bytes long, error string")

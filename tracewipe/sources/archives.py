"""Members of ZIP archives of any size, read by byte ranges.

Archives of up to ``partitionBytes`` are dealt to partitions by their sizes alone; tasks take the tail of each
for its end record, then the central directory. Of larger ones the driver reads the directory and plans
partitions of neighbouring members of about ``partitionBytes`` packed bytes; tasks open the archive at their
members' places. No row and no task ever holds an archive, and ZIP64 archives are read, so an archive may be
larger than any limit on rows. The plan is a name for each small archive and a few dozen bytes for each
member of a large one.

One row per member: archive, ord, member, method, size, data, error. Folders are members without bytes.
A member that cannot be read is a row with its ``error`` (malformed, encrypted, unsupported, too_large); an
archive without a sound directory is one row with a null member.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.formats.archive import CENTRAL, DEFLATED, END, LOCAL, MOST_INFLATED, STORED
from ..operators.model import ScrubError, malformed
from ..session import prepare
from .published import _opened

TAIL = 22 + 65_535 + 20
ROW = "archive string, ord int, member string, method int, size long, data binary, error string"
WIDE_END, WIDE_PLACE = b"PK\6\6", b"PK\6\7"
PIECE = 1 << 20
OPENED = 1 << 16  # what opening an archive weighs
_Member = tuple[int, str, int, int, int, int, int, int]  # ord, name, flags, method, crc, packed, size, offset


def _directory(f, size: int) -> tuple[int, int, int]:
    """(entries, offset, bytes) of the central directory."""
    f.seek(max(0, size - TAIL))
    tail = f.read(TAIL)
    end = tail.rfind(END)
    if end < 0 or len(tail) < end + 22:
        raise malformed("ZIP", "there is no end record")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        if end < 20 or tail[end - 20 : end - 16] != WIDE_PLACE:
            raise malformed("ZIP", "there is no ZIP64 end record")
        f.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        wide = f.read(56)
        if len(wide) < 56 or wide[:4] != WIDE_END:
            raise malformed("ZIP", "the ZIP64 end record is cut short")
        count, length, at = struct.unpack_from("<QQQ", wide, 32)
    if at + length > size:
        raise malformed("ZIP", "the central directory is cut short")
    return count, at, length


def _wide(extra: bytes, packed: int, size: int, offset: int) -> tuple[int, int, int]:
    """The three numbers, from the ZIP64 field where they do not fit."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            size = next(values, size) if size == 0xFFFFFFFF else size
            packed = next(values, packed) if packed == 0xFFFFFFFF else packed
            offset = next(values, offset) if offset == 0xFFFFFFFF else offset
        at += 4 + n
    return packed, size, offset


def listed(f, size: int) -> list[_Member]:
    count, at, length = _directory(f, size)
    f.seek(at)
    data, out, p = f.read(length), [], 0
    for k in range(count):
        if data[p : p + 4] != CENTRAL or len(data) < p + 46:
            raise malformed("ZIP", "the central directory is cut short")
        flags, method, _, _, crc, packed, size_, n_name, n_extra, n_comment = struct.unpack_from("<HHHHIIIHHH", data, p + 8)
        (offset,) = struct.unpack_from("<I", data, p + 42)
        name = data[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        packed, size_, offset = _wide(data[p + 46 + n_name : p + 46 + n_name + n_extra], packed, size_, offset)
        out.append((k, name, flags, method, crc, packed, size_, offset))
        p += 46 + n_name + n_extra + n_comment
    return out


def unpacked(f, member: _Member, most: int) -> bytes:
    _, name, flags, method, crc, packed, size, offset = member
    if flags & 1:
        raise ScrubError("encrypted", "ZIP", name)
    if method not in (STORED, DEFLATED):
        raise ScrubError("unsupported", "ZIP", name)
    if size > most:
        raise ScrubError("too_large", "ZIP", name)
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != LOCAL:
        raise malformed("ZIP", "an entry has no local header")
    f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    inflate, out, left = zlib.decompressobj(-15) if method == DEFLATED else None, bytearray(), packed
    while left and (piece := f.read(min(PIECE, left))):
        left -= len(piece)
        try:
            out += inflate.decompress(piece, most + 1 - len(out)) if inflate else piece
        except zlib.error as e:
            raise malformed("ZIP", f"{name}: {e}") from e
        if len(out) > most:
            raise ScrubError("too_large", "ZIP", name)
    if left or len(out) != size or zlib.crc32(out) != crc:
        raise malformed("ZIP", f"{name} is not what its entry says")
    return bytes(out)


class _Ranges(InputPartition):
    """Members of one large archive or several small archives: (folder, name, members or None for all, error of the archive)."""

    def __init__(self, parts: list[tuple[str, str, list[_Member] | None, str | None]]):
        self.parts = parts


def _found(files: pafs.FileSystem, at: str) -> Iterator[tuple[str, str, int]]:
    """(folder, name, size) of the files at or below a path, a folder at a time; names that begin with _ or . are left out."""
    info = files.get_file_info(at)
    if info.type == pafs.FileType.File:
        yield at.rpartition("/")[0], info.base_name, info.size
        return
    folders = [at]
    while folders:
        folder = folders.pop()
        for i in sorted(files.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
            if i.base_name.startswith(("_", ".")):
                continue
            if i.type == pafs.FileType.File:
                yield folder, i.base_name, i.size
            elif i.type == pafs.FileType.Directory:
                folders.append(i.path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, most: int):
        self.path, self.partition_bytes, self.most = path, partition_bytes, most

    def partitions(self) -> list[_Ranges]:
        files, at = _opened(self.path)
        out, held, weight = [], [], 0
        for folder, name, size in _found(files, at):
            if held and weight >= self.partition_bytes:
                out.append(_Ranges(held))
                held, weight = [], 0
            weight += OPENED
            if size <= self.partition_bytes:
                held.append((folder, name, None, None))
                weight += size
                continue
            try:
                with files.open_input_file(f"{folder}/{name}") as f:
                    members, error = listed(f, size), None
            except ScrubError as e:
                members, error = [], e.cls
            held.append((folder, name, [], error))
            for m in members:
                if weight >= self.partition_bytes:
                    out.append(_Ranges(held))
                    held, weight = [(folder, name, [], None)], 0
                held[-1][2].append(m)
                weight += m[5]
        return [*out, _Ranges(held)] if held else out

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        files, _ = _opened(self.path)
        for folder, name, members, error in partition.parts:
            archive = f"{folder}/{name}"
            if error or members == []:
                if error:
                    yield archive, None, None, None, None, None, error
                continue
            with files.open_input_file(archive) as f:
                if members is None:
                    try:
                        members = listed(f, f.size())
                    except ScrubError as e:
                        yield archive, None, None, None, None, None, e.cls
                        continue
                for m in members:
                    try:
                        data, error = unpacked(f, m, self.most), None
                    except ScrubError as e:
                        data, error = None, e.cls
                    yield archive, m[0], m[1], m[3], m[6], data, error


class Archives(DataSource):
    """``spark.read.format("tracewipe_archives").load(path)``; options partitionBytes and mostBytes (of a member)."""

    @classmethod
    def name(cls) -> str:
        return "tracewipe_archives"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("partitionBytes", 64 << 20)), int(self.options.get("mostBytes", MOST_INFLATED)))


def read_archives(spark: SparkSession, path: str, partition_bytes: int = 64 << 20, most: int = MOST_INFLATED) -> DataFrame:
    """Members of the archive at ``path``, or of all archives below it."""
    prepare(spark).dataSource.register(Archives)
    return spark.read.format("tracewipe_archives").option("partitionBytes", partition_bytes).option("mostBytes", most).load(path)

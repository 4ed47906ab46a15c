"""ZIP archives read and written at header level, so that nothing of the old headers survives."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from ..model import ENTRY, Report, ScrubError, malformed
from .cursor import number_at

MOST_INFLATED = 128 << 20
STORED, DEFLATED = 0, 8
DOS_DATE = 0x0021  # 1980-01-01
MADE_BY = 0x0014
LOCAL, CENTRAL, END = b"PK\3\4", b"PK\1\2", b"PK\5\6"


@dataclass
class Member:
    name: bytes
    flags: int
    method: int
    crc: int
    size: int
    packed: bytes

    @property
    def path(self) -> str:
        return self.name.decode("utf-8", "replace")

    def read(self) -> bytes:
        if self.method == STORED:
            out = self.packed
        elif self.method == DEFLATED:
            d = zlib.decompressobj(-15)
            try:
                out = d.decompress(self.packed, MOST_INFLATED + 1)
            except zlib.error as e:
                raise malformed("ZIP", f"{self.path}: {e}") from e
        else:
            raise ScrubError("unsupported", "ZIP", f"compression method {self.method}")
        if len(out) > MOST_INFLATED:
            raise ScrubError("too_large", "ZIP", f"{self.path} unpacks to more than {MOST_INFLATED} bytes")
        if zlib.crc32(out) != self.crc:
            raise malformed("ZIP", f"{self.path} does not have its checksum")
        return out

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data), len(data)
        if self.method == DEFLATED:
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            self.packed = c.compress(data) + c.flush()
        else:
            self.method, self.packed = STORED, data


def read(data: bytes, report: Report | None = None) -> list[Member]:
    """The members in central-directory order; the extra fields and comments that go are noted."""
    end = data.rfind(END, max(0, len(data) - 65_557))
    if end < 0 or len(data) < end + 22:
        raise malformed("ZIP", "there is no end record")
    count, at, comment = number_at(data, end + 10, 2, "little"), number_at(data, end + 16, 4, "little"), number_at(data, end + 20, 2, "little")
    if count == 0xFFFF or at == 0xFFFFFFFF:
        raise ScrubError("unsupported", "ZIP", "ZIP64 archives are not read")
    out, dropped, stored = [], comment, 0
    for _ in range(count):
        if data[at : at + 4] != CENTRAL or len(data) < at + 46:
            raise malformed("ZIP", "the central directory is cut short")
        flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment = struct.unpack_from("<HHHHIIIHHH", data, at + 8)
        offset = number_at(data, at + 42, 4, "little")
        if flags & 1:
            raise ScrubError("encrypted", "ZIP", "an entry is encrypted")
        if 0xFFFFFFFF in (packed, size, offset):
            raise ScrubError("unsupported", "ZIP", "ZIP64 entries are not read")
        name = data[at + 46 : at + 46 + n_name]
        if data[offset : offset + 4] != LOCAL or len(data) < offset + 30:
            raise malformed("ZIP", "an entry has no local header")
        start = offset + 30 + number_at(data, offset + 26, 2, "little") + number_at(data, offset + 28, 2, "little")
        dropped += n_extra + n_comment + number_at(data, offset + 28, 2, "little")
        stored += packed
        if start + packed > len(data) or stored > len(data):
            raise malformed("ZIP", "entries overlap or lie outside the file")
        out.append(Member(name, flags & 0x0800, method, crc, size, data[start : start + packed]))
        at += 46 + n_name + n_extra + n_comment
    if report is not None:
        report.drop(ENTRY, "archive entry timestamps and extra fields", dropped)
    return out


def write(members: list[Member]) -> bytes:
    """An archive whose headers say the same for every member but name, sizes and checksum."""
    body, directory, at = [], [], 0
    for m in members:
        head = struct.pack("<HHHHHIIIH", 20, m.flags, m.method, 0, DOS_DATE, m.crc, len(m.packed), m.size, len(m.name))
        local = LOCAL + head + b"\0\0" + m.name + m.packed
        directory.append(CENTRAL + struct.pack("<H", MADE_BY) + head + b"\0" * 12 + struct.pack("<I", at) + m.name)
        body.append(local)
        at += len(local)
    tail = b"".join(directory)
    return b"".join(body) + tail + END + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(tail), at, 0)

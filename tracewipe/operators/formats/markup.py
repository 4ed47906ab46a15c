"""Lexing and editing of XML-like bytes, shared by SVG, office parts and HTML pages.

A lexer cuts the bytes into tokens; editors decide token by token. Everything works on bytes, so no
character is ever split and undecodable input passes through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

# comment, CDATA, processing instruction, declaration, tag (quotes may hold ">"), text; an opener that
# nothing closes matches as "cut"
_TOKEN = re.compile(
    rb"(?P<comment><!--.*?-->)|(?P<cdata><!\[CDATA\[.*?\]\]>)|(?P<pi><\?[^>]*>)|(?P<decl><!(?!--)[^>]*>)"
    rb"|(?P<close></(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>)|(?P<open><(?![!?/])(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>)|(?P<text>[^<]+)|(?P<cut><.*)",
    re.DOTALL,
)
_NAME = re.compile(rb"</?\s*([^\s/>]*)")
_ATTRIBUTE = re.compile(rb"(\s*)([^\s=/>]+)(?:(\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>]*))?")


@dataclass
class Token:
    kind: str
    raw: bytes

    @property
    def name(self) -> bytes:
        m = _NAME.match(self.raw)
        return m[1] if m else b""

    @property
    def local(self) -> bytes:
        return self.name.rpartition(b":")[2].lower()

    @property
    def empty(self) -> bool:
        return self.raw.endswith(b"/>")


def tokens(data: bytes) -> Iterator[Token]:
    for m in _TOKEN.finditer(data):
        yield Token(m.lastgroup, m[0])


def without_elements(stream: Iterator[Token], drops: Callable[[Token], bool], dropped: Callable[[Token], None]) -> Iterator[Token]:
    """The tokens outside elements that ``drops`` names; nested elements of one name are counted.

    An element that is never closed takes the rest with it.
    """
    depth, name = 0, b""
    for t in stream:
        if depth:
            if t.kind == "open" and t.name == name and not t.empty:
                depth += 1
            elif t.kind == "close" and t.name == name:
                depth -= 1
        elif t.kind == "open" and drops(t):
            dropped(t)
            if not t.empty:
                depth, name = 1, t.name
        else:
            yield t


@dataclass
class Attribute:
    before: bytes  # white space
    key: bytes
    equals: bytes | None
    value: bytes  # with its quotes

    @property
    def local(self) -> bytes:
        return self.key.rpartition(b":")[2].lower()

    def bare(self) -> tuple[bytes, bytes]:
        """The quote (or none) and the value inside it."""
        q = self.value[:1]
        return (q, self.value[1:-1]) if q in (b'"', b"'") and len(self.value) > 1 else (b"", self.value)

    def raw(self) -> bytes:
        return self.before + self.key + ((self.equals + self.value) if self.equals is not None else b"")


def edit_attributes(tag: bytes, edit: Callable[[Attribute], Attribute | None]) -> bytes:
    """A start tag with each attribute edited, or dropped with the white space before it."""
    head = _NAME.match(tag)
    end = len(tag) - (2 if tag.endswith(b"/>") else 1)
    out, at = [tag[: head.end()]], head.end()
    while at < end and (m := _ATTRIBUTE.match(tag, at, end)) and m.end() > at:
        a = edit(Attribute(m[1], m[2], m[3], m[4] or b""))
        if a is not None:
            out.append(a.raw())
        at = m.end()
    return b"".join(out) + tag[at:]


# --- office rules ------------------------------------------------------------------------------

# Fixed values: (local name, prefix match, action: new value, or None to remove)
RULES = (
    (b"author", False, b"author"), (b"creator", False, b"author"), (b"lastmodifiedby", False, b"author"), (b"initials", False, b"a"),
    (b"userid", False, None), (b"providerid", False, None), (b"date", False, None), (b"dateutc", False, None), (b"rsid", True, None),
)
NAME_RULES = ((b"name", False, b"author"), (b"displayname", False, b"author"))


def scrub_attributes(data: bytes, rules=RULES) -> tuple[bytes, int, int]:
    """The bytes with identifying attributes blanked or removed, and how many of each."""
    blanked = removed = 0

    def edit(a: Attribute) -> Attribute | None:
        nonlocal blanked, removed
        if a.equals is None or a.key.lower().startswith(b"xmlns"):
            return a
        for name, prefix, new in rules:
            if a.local == name or prefix and a.local.startswith(name):
                if new is None:
                    removed += 1
                    return None
                q, value = a.bare()
                if value == new:
                    return a
                blanked += 1
                return Attribute(a.before, a.key, a.equals, q + new + q)
        return a

    out = [edit_attributes(t.raw, edit) if t.kind == "open" else t.raw for t in tokens(data)]
    return b"".join(out), blanked, removed


def remove_elements(data: bytes, names: frozenset[bytes]) -> tuple[bytes, int]:
    """The bytes without the elements of these local names (lower case), and their number."""
    gone: list[Token] = []
    out = [t.raw for t in without_elements(tokens(data), lambda t: t.local in names, gone.append)]
    return b"".join(out), len(gone)


def blank_text(data: bytes, names: frozenset[bytes], new: bytes = b"author") -> tuple[bytes, int]:
    """The bytes with the text directly inside these elements replaced, and how many were."""
    out, count, inside = [], 0, False
    for t in tokens(data):
        if t.kind == "open" and not t.empty:
            inside = t.local in names
        elif t.kind in ("open", "close"):
            inside = False
        elif inside and t.kind in ("text", "cdata") and t.raw.strip() and t.raw != new:
            count += 1
            out.append(new)
            continue
        out.append(t.raw)
    return b"".join(out), count


# --- references and style sheets -----------------------------------------------------------------

SCHEMES = frozenset((b"http", b"https", b"ftp", b"ftps", b"file", b"ws", b"wss", b"javascript", b"vbscript"))
_REFERENCE = re.compile(rb"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?")
_CSS = re.compile(rb"@import[^;]*(?:;|$)|url\(([^)]*)\)", re.IGNORECASE)
SCHEME_LENGTH = 16


def scheme(value: bytes) -> bytes:
    """What a browser takes for the scheme: references decoded, blanks and controls skipped, up to ":"."""
    out, at = b"", 0
    while at < len(value) and len(out) < SCHEME_LENGTH:
        m = _REFERENCE.match(value, at)
        code = (int(m[1], 16) if m[1] else int(m[2])) if m else value[at]
        at = m.end() if m else at + 1
        if code == 0x3A:
            break
        if 0x20 < code < 0x7F:
            out += bytes((code,)).lower()
        elif 0x80 <= code <= 0xFF and not m:
            out += bytes((code,))
    return out


def leaves_document(value: bytes) -> bool:
    s = scheme(value.strip().strip(b"\"'").strip())
    return s in SCHEMES or s.startswith(b"//")


def neutral_css(css: bytes) -> tuple[bytes, int]:
    """The style sheet without imports and with outside ``url()`` targets blanked, and how many."""
    count = 0

    def edit(m: re.Match) -> bytes:
        nonlocal count
        if m[1] is None:
            count += 1
            return b""
        if leaves_document(m[1]):
            count += 1
            return b"url(about:blank)"
        return m[0]

    return _CSS.sub(edit, css), count

"""Text predicates and edits as Spark expressions, where a regular expression is enough.

``strip_comments`` and ``strip_scripts`` cover well-formed markup; nested or broken markup goes through
the scrubber in ``operators.formats.svg``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMES = ("http", "https", "ftp", "ftps", "file", "ws", "wss", "javascript", "vbscript")


def strip_comments(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?s)<!--.*?-->", "")


def strip_scripts(markup: Column) -> Column:
    return F.regexp_replace(markup, r"(?s)<script[^>]*>.*?</script>", "")


def leaves_document(reference: Column) -> Column:
    """Whether a plain reference (without character references) points outside the document."""
    bare = F.lower(F.regexp_replace(F.trim(reference), r"[\x00-\x20]+", ""))
    return bare.startswith("//") | F.substring_index(bare, ":", 1).isin(*SCHEMES) & F.contains(bare, F.lit(":"))


def neutral_css(css: Column) -> Column:
    """Without imports, and with plain outside ``url()`` targets blanked."""
    no_import = F.regexp_replace(css, r"(?i)@import[^;]*(;|$)", "")
    return F.regexp_replace(no_import, r"(?i)url\(\s*[\"']?\s*((https?|ftps?|file|wss?|javascript|vbscript):|//)[^)]*\)", "url(about:blank)")


def matches_search(query: str | Column, *fields: Column) -> Column:
    """Case-insensitive substring in any field; an empty query matches all, and so does a column's empty value."""
    if isinstance(query, str):
        if not query:
            return F.lit(True)
        query = F.lit(query)
    return reduce(Column.__or__, [F.contains(F.lower(f), F.lower(query)) for f in fields])


def file_extension(path: Column) -> Column:
    """The last extension of the name, or null; a leading dot is part of the name."""
    e = F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)
    return F.when(e != "", e)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")

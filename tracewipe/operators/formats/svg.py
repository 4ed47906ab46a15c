"""SVG (and HTML by the same rules): comments, scripts, editor data and outside references go."""

from __future__ import annotations

from ..model import BEST_EFFORT, COMMENT, DOCUMENT, UNKNOWN, XMP, Policy, Report
from .markup import Attribute, Token, edit_attributes, leaves_document, neutral_css, tokens, without_elements

# Fixed values
METADATA, SCRIPT = frozenset((b"metadata", b"rdf")), frozenset((b"script",))
EDITORS = (b"inkscape:", b"sodipodi:", b"adobe:", b"i:", b"x:", b"illustrator:")
PAINT = frozenset((b"fill", b"stroke", b"filter", b"mask", b"clip-path", b"cursor", b"marker", b"marker-start", b"marker-mid", b"marker-end"))
REASONS = ("comments", "metadata", "scripts", "editor", "external")


def scrub(data: bytes) -> tuple[bytes, dict[str, int]]:
    """The cleaned markup and what went, by reason."""
    n = dict.fromkeys(REASONS, 0)
    text = data.decode("utf-8", "replace").encode()

    def of_element(t: Token) -> str | None:
        if t.local in METADATA:
            return "metadata"
        if t.local in SCRIPT:
            return "scripts"
        return "editor" if t.name.lower().startswith(EDITORS) else None

    def dropped(t: Token) -> None:
        n[of_element(t)] += 1

    def edit(a: Attribute) -> Attribute | None:
        key = a.key.lower()
        if key.startswith((b"on", *EDITORS)):
            n["editor"] += 1
            return None
        if (a.local == b"href" or key == b"src") and leaves_document(a.value):
            n["external"] += 1
            return None
        if key == b"style" or key in PAINT:
            q, value = a.bare()
            css, k = neutral_css(value)
            n["external"] += k
            return Attribute(a.before, a.key, a.equals, q + css + q) if k else a
        return a

    def uncommented():
        for t in tokens(text):
            if t.kind == "comment":
                n["comments"] += 1
            elif t.kind != "cut":
                yield t

    out, style = [], False
    for t in without_elements(uncommented(), lambda t: of_element(t) is not None, dropped):
        if t.kind == "open":
            out.append(edit_attributes(t.raw, edit))
            style = t.local == b"style" and not t.empty
        elif style and t.kind in ("text", "cdata"):
            css, k = neutral_css(t.raw)
            n["external"] += k
            out.append(css)
        else:
            style = style and t.kind != "close"
            out.append(t.raw)
    return b"".join(out), n


def clean(data: bytes, policy: Policy, report: Report) -> bytes:
    report.weaken(BEST_EFFORT)
    out, n = scrub(data)
    for reason, kind, where in (
        ("comments", COMMENT, f"{n['comments']} XML comment(s)"), ("metadata", XMP, "metadata / RDF block"), ("scripts", UNKNOWN, f"{n['scripts']} script element(s)"),
        ("editor", DOCUMENT, f"{n['editor']} editor field(s)"), ("external", UNKNOWN, f"{n['external']} external reference(s)"),
    ):
        if n[reason]:
            report.drop(kind, where, 0)
    report.warnings.append("SVG_EDITED")
    return out

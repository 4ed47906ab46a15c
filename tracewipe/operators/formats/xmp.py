"""XMP sidecars: known properties are reported, the packet is replaced by an empty one."""

from __future__ import annotations

from ..model import AUTHOR, CUSTOM, EXIF, MAKER_NOTE, REVISION, TIMESTAMP, Policy, Report

# Property names to report, letter case aside.
MARKERS = (
    ("dc:creator", AUTHOR), ("dc:rights", AUTHOR), ("photoshop:Credit", AUTHOR), ("photoshop:AuthorsPosition", AUTHOR), ("aux:SerialNumber", MAKER_NOTE),
    ("aux:LensSerialNumber", MAKER_NOTE), ("xmp:CreateDate", TIMESTAMP), ("xmp:ModifyDate", TIMESTAMP), ("xmp:MetadataDate", TIMESTAMP), ("photoshop:DateCreated", TIMESTAMP),
    ("exif:DateTimeOriginal", TIMESTAMP), ("exif:GPS", EXIF), ("xmpMM:History", REVISION), ("xmpMM:DocumentID", REVISION), ("xmpMM:InstanceID", REVISION),
    ("xmpMM:OriginalDocumentID", REVISION), ("dc:subject", CUSTOM), ("lr:hierarchicalSubject", CUSTOM),
)
EMPTY = (
    b'<?xpacket begin="\xef\xbb\xbf" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
    b'  <rdf:Description rdf:about=""/>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'
)


def clean(data: bytes, policy: Policy, report: Report) -> bytes:
    low = data.lower()
    for name, kind in MARKERS:
        if name.lower().encode() in low:
            report.drop(kind, f"XMP property {name}", 0)
            report.found_location |= name == "exif:GPS"
    report.warnings.append("XMP_EMPTIED")
    return EMPTY

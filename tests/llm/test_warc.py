import base64
import hashlib
import io
from collections import Counter

import pytest

from tracewipe.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, "http://a/3", "same"), (2, "http://a/2", None), (4, None, ""), (6, "http://b\r\nX: y", "ünï" * 400), (7, "u" * 200_000, "lone"), (8, "u8", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "same")]


def brute(rows, least=0):
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    out = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        response = len(b) < least or p == best[h or ""]
        out[(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else best[h or ""])] += 1
    return out


def got(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize(("least", "chunk"), [(0, 1 << 18), (0, 7), (5, 1 << 18)])
def test_round_trip(sp, least, chunk):
    pages = sp.createDataFrame(ROWS, PAGES)
    assert got(warc.round_trip(pages, least, chunk)) == brute(ROWS, least)


def test_chunks_carry_running_digests_and_payload(sp):
    pages = sp.createDataFrame([(1, "u", "abcdefghij" * 3), (2, "v", "")], PAGES).withColumn("sha1", warc.F.lit("x"))
    folder, manifest = warc.write_archives(pages, chunk=8)
    rows = sorted(warc.read_archives(folder, manifest, chunk=8, data=True).collect(), key=lambda r: (r.page_id, r.chunk_no))
    data = b""
    for r in (r for r in rows if r.page_id == 1):
        data += r.data
        assert r.start + r.length == len(data) and len(r.data) <= 8
        assert r.digest == warc.bare_digest(hashlib.sha1(data).digest())
    assert data == b"abcdefghij" * 3 and [r.last for r in rows] == [False, False, False, True, True]
    assert manifest.agg({"records": "sum"}).first()[0] == 2


def test_repeated_rows_and_empty_table(sp):
    rows = [(1, "u", "x")] * 3
    out = warc.round_trip(sp.createDataFrame(rows, PAGES)).collect()
    assert Counter((r.record_type, r.refers_to) for r in out) == {("response", None): 1, ("revisit", 1): 2}
    assert warc.round_trip(sp.createDataFrame([], PAGES)).count() == 0


def test_damaged_archives_raise():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Type: text/html\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r[8] for r in warc.stream_records(io.BytesIO(good))] == [warc.bare_digest(hashlib.sha1(b"abc").digest())]
    for bad in (b"hello\r\n\r\n", good[:-3], good[:60], good[: good.index(b"abc") + 1], good.replace(b"abc\r\n\r\n", b"abcdefg")):
        with pytest.raises((ValueError, KeyError)):
            list(warc.stream_records(io.BytesIO(bad)))

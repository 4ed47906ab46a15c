import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewipe.llm import packing

TEXTS = [None, "", "a", "Hello  world,\n\nit's 12345 ünï ¿qué? 漢字 🙂", "word " * 5000, " \t\n  x", "<|endoftext|> inside", "a" * 20000, "<|endoftext|><|endoftext|> x <|endoftext", " " * 1_000_000 + "end", "\u0000\x01퟿"]


@pytest.fixture(scope="module")
def slow():
    t = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def test_encoder_gives_the_librarys_ids(slow):
    fast = packing.encoder(packing.default_tokenizer())
    for t in TEXTS:
        if t:
            assert fast(t).tolist() == slow(t)


def test_binary_lengths():
    for n in [1, 2, 3, 2047, 2048, 2049, 5000, 4096]:
        parts = packing.binary_lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts) and parts == sorted(parts, reverse=True)
        assert len(set(p for p in parts if p < 2048)) == len([p for p in parts if p < 2048])


def test_pieces_rebuild_every_document(documents, slow):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None), (None, "b c", None, None)]
    out = packing.pack(documents(rows)).toPandas()
    assert out.sequence_id.is_unique and (out.offset == 0).all()
    assert ((out.length & (out.length - 1)) == 0).all() and out.length.max() <= 2048
    for i, t in enumerate(TEXTS):
        ids = np.array([*slow(t), 1], "<u4")
        mine = out[out.doc_id == i].sort_values(["start", "sequence_id"])
        copies = 2 if i == 3 else 1
        assert mine.length.sum() == copies * len(ids) and (mine.doc_tokens == len(ids)).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert out[out.doc_id.isna()].length.sum() == len(slow("b c")) + 1


def test_equal_lengths_share_a_bucket(documents):
    out = packing.pack(documents([(i, "x " * i, None, None) for i in range(50)])).toPandas()
    assert ((out.sequence_id.to_numpy() >> 56) == np.log2(out.length.to_numpy())).all()
    assert packing.pack(documents([])).count() == 0

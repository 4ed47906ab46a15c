"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens (its end token included) is cut into as many pieces of ``MAX_LENGTH`` as fit
and then into the binary digits of the rest, longest first. Every piece is a sequence of its own;
sequences of one length share a bucket, which the top bits of ``sequence_id`` name, so a reader
that takes a range of ids trains on equal lengths without padding (variable-length curricula).

The pass over the documents is one map: nothing is shuffled, and memory is one document's ids.

Defined results: null text counts as empty and gives one piece with the end token alone; repeated
rows give their pieces again under other sequence ids; null ids stay null; strings of special tokens
inside a text become these tokens' ids, as the library has it. A very long text is encoded whole, its
ids in one array of 4 bytes each, and cut like any other. Lone surrogates cannot occur in Spark
strings. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in own):
        out[chr(256 + k)] = b
    return out


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to token ids of the byte-level BPE file at ``path``.

    These are the ids of the tokenizers library's ``encode(text, add_special_tokens=False)``. The file's
    merges follow its ids, so the ids are also ranks, and a faster encoder gives the same ids (tests
    compare them). Texts that hold a special token's string, which the library takes for that token,
    and texts beyond the fast encoder's stack go to the library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    letters = _byte_alphabet()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> np.ndarray:
        if not any(t in text for t in special):
            try:
                return np.frombuffer(array("I", fast.encode_ordinary(text)), np.uint32)
            except BaseException as e:
                # a very long run of white space uses up the regular expression's stack; that is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        if not slow:
            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def binary_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """``n`` as a sum of ``most`` as often as it fits and then falling powers of two."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(most.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(path: str, most: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = TaskContext.get().partitionId() << 31
        made = 0
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.append(encode(text) if text else np.array([], np.uint32), np.uint32(end)).astype("<u4")
                doc, raw, at = doc.as_py(), memoryview(ids.tobytes()), 0
                for n in binary_lengths(len(ids), most):
                    rows.append((doc, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(ids), n.bit_length() - 1 << 56 | base + made, 0))
                    at, made = at + n, made + 1
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = MAX_LENGTH, end: int = END_ID) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    if most < 1 or most & most - 1:
        raise ValueError("the longest piece must be a power of two")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer or default_tokenizer(), most, end), PIECES)

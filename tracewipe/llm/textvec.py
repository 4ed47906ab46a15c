"""Vectorised word and shingle hashes of whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes, with A-Z lower-cased. All hashing is
numpy over byte arrays; a text longer than ``CHUNK`` bytes is cut at white space, so memory does
not grow with a factor of the longest text.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_STEP_INV = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_POSITION = mix(np.arange(1001, 1033, dtype=np.uint64)) | _U(1)


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = []
        for base in (_STEP, _STEP_INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers.append(np.multiply.accumulate(a))
    return _powers


def _hash_chunk(b: np.ndarray) -> np.ndarray:
    space = _SPACE[b]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edges[0::2], edges[1::2]
    power, inverse = _power_tables(len(b) + 1)
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def _chunks(b: np.ndarray):
    at = 0
    while at < len(b):
        stop = at + CHUNK
        if stop < len(b):
            near = np.flatnonzero(_SPACE[b[at:stop]])
            if len(near):
                stop = at + int(near[-1]) + 1
            else:  # one word fills the chunk: go on to its end
                while stop < len(b) and not len(near := np.flatnonzero(_SPACE[b[stop : stop + CHUNK]])):
                    stop += CHUNK
                stop = min(len(b), stop + int(near[0]) + 1 if len(near) else len(b))
        yield b[at:stop]
        at = stop


def word_hashes(text: bytes) -> np.ndarray:
    """One uint64 for each word of the whole text, in order."""
    b = np.frombuffer(text, np.uint8)
    if len(b) <= CHUNK:
        return _hash_chunk(b)
    return np.concatenate([_hash_chunk(c) for c in _chunks(b)])


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct uint64 hashes of the text's word shingles.

    With fewer words than ``width`` the whole sequence is one shingle; without words there is none.
    """
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h += mix(w[i : i + n] ^ _POSITION[i]) * _POSITION[i + 8]
    return np.unique(mix(h))


def set_digests(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Two signed 64-bit digests of a sorted hash set and its size, the first an even number; ``salt`` gives others."""
    size = _U(len(s))
    with np.errstate(over="ignore"):
        own = mix(np.array([salt], np.uint64))[0]
        a = np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D) ^ own), dtype=np.uint64)
        b = np.bitwise_xor.reduce(s * _U(0x2545F4914F6CDD1D)) if len(s) else _U(0)
        c = np.add.reduce(mix(s + _U(0x9E6C63D0876A9A47) + own), dtype=np.uint64)
        inner = mix(np.array([b + size, b - size], np.uint64))
        out = mix(np.array([a ^ inner[0], c ^ inner[1]], np.uint64)).view(np.int64)
    return int(out[0]) & ~1, int(out[1])

"""Vectorised word hashing and word shingles over whole texts.

A text becomes UTF-8 bytes; a 256-entry table gives each byte its class: 0 for a
separator, else a code (upper-case ASCII shares the code of lower case). A word's
hash is a polynomial in its byte codes modulo 2**64, so one pass of array
operations hashes every word of a batch, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18


def byte_classes(separators: bytes) -> np.ndarray:
    """Class table: separators are 0, A-Z share the class of a-z."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] = table[97:123]
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: White space only: words are ``[^\x20\x09-\x0D]+``.
SPACES = byte_classes(b" \t\n\v\f\r")
#: Every ASCII byte that is no letter or digit separates: punctuation does not matter.
PLAIN = byte_classes(bytes(c for c in range(128) if not chr(c).isalnum()))

_CODES = np.random.default_rng(20).integers(1, 2**63, 257, dtype=np.uint64) * _U(2) + _U(1)
_CODES[0] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 2 * _PIECE)
        _tables["up"] = _powers(_BASE, size)
        _tables["down"] = _powers(pow(_BASE, -1, 2**64), size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply rounds)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hash_piece(data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of ``data``."""
    codes = classes[np.frombuffer(data, np.uint8)]
    inside = codes > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power_tables(len(codes))
    sums = np.add.reduceat(_CODES[codes] * up[: len(codes)], starts)
    return starts, mix(sums * down[starts] + (ends - starts).astype(np.uint64))


def _cut(data: bytes, classes: np.ndarray) -> Iterator[bytes]:
    """Pieces of a long text, cut at separators only."""
    at = 0
    while len(data) - at > _PIECE:
        end = at + _PIECE
        while end < len(data):
            gap = np.flatnonzero(classes[np.frombuffer(data, np.uint8, min(_PIECE, len(data) - end), end)] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + _PIECE)
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list[str | None], classes: np.ndarray) -> Iterator[np.ndarray]:
    """One array of word hashes for each text, in order; null is an empty text."""
    pending: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        starts, hashes = _hash_piece(b"\n".join(pending) + b"\n", classes)
        begin = np.cumsum([0] + [len(x) + 1 for x in pending])
        cut = np.searchsorted(starts, begin)
        for i in range(len(pending)):
            yield hashes[cut[i] : cut[i + 1]]

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > _PIECE:
            yield from flush() if pending else ()
            pending, size = [], 0
            yield np.concatenate([_hash_piece(x, classes)[1] for x in _cut(data, classes)])
            continue
        if size + len(data) > _PIECE:
            yield from flush()
            pending, size = [], 0
        pending.append(data)
        size += len(data) + 1
    if pending:
        yield from flush()


_STEP = np.random.default_rng(21).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    span = min(n, width)
    total = np.full(n - span + 1, _U(span)) * _STEP[63]
    for j in range(span):
        total += words[j : n - span + 1 + j] * _STEP[j]
    return np.unique(mix(total))


def shingle_sets(texts: list[str | None], width: int, classes: np.ndarray) -> Iterator[np.ndarray]:
    for words in word_hashes(texts, classes):
        yield shingle_set(words, width)

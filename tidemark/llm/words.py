"""Word and shingle hashes of many texts at once, with numpy on the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Odd multipliers for the words of a shingle.
_PLACES = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F]
#: Texts are hashed in pieces of about so many bytes, which bounds memory.
PIECE = 1 << 19
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, PIECE + (PIECE >> 2)), base, dtype=U)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * _power("up", _BASE, len(raw))[: len(raw)], out=sums[1:])
    if not len(starts):
        return starts, np.zeros(0, dtype=U)
    return starts, mix((sums[ends] - sums[starts]) * _power("down", _BASE_INV, len(raw) + 1)[starts] + (ends - starts).astype(U) * U(_PLACES[0]))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each run of bytes other than space and \\t-\\r."""
    if len(data) <= 2 * PIECE:
        return _hash_piece(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":  # a piece ends at white space; a longer word is its own piece
            stops = [p for p in (data.find(c, end, end + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
            end = min(stops) if stops else min(len(data), end + PIECE)
        starts, hashes = _hash_piece(data[at:end])
        out.append((starts + at, hashes))
        at = end
    return np.concatenate([s for s, _ in out]), np.concatenate([h for _, h in out])


def column_bytes(column: pa.Array) -> Iterator[bytes | None]:
    return (text.as_py() for text in column.cast(pa.binary()))


def _parts(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """Texts (null: empty) in lists of about PIECE bytes together, or one longer text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or b"") > PIECE:
            yield part
            part, size = [], 0
        part.append(text or b"")
        size += len(part[-1]) + 1
    if part:
        yield part


def shingle_sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct five-word shingle hashes; A-Z count as a-z.

    A text of one to four words has one shingle, its whole sequence; no words or null: none.
    """
    for part in _parts(texts):
        bounds = np.cumsum([0] + [len(t) + 1 for t in part])
        starts, h = word_hashes(b"\n".join(part).translate(_LOWER))
        cut = np.searchsorted(starts, bounds)
        n = max(0, len(h) - 4)
        s = np.zeros(n, dtype=U)
        for k in range(5):
            s += h[k : k + n] * U(_PLACES[k])
        s = mix(s)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= 5:
                yield np.unique(s[a : b - 4])
            elif b > a:
                whole = U(b - a)
                for k in range(b - a):
                    whole = np.uint64((int(whole) + int(h[a + k]) * _PLACES[k]) & 0xFFFFFFFFFFFFFFFF)
                yield mix(np.array([whole], dtype=U))
            else:
                yield np.zeros(0, dtype=U)

"""Numpy helpers shared by the text operators: rolling digests, word splitting and packed integer columns.

They run inside Spark tasks on one bounded batch of documents at a time.
"""

from __future__ import annotations

import numpy as np
import zstandard

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_ODDS = (_ODD, 0xD6E8FEB86659FD93)
_TABLES: dict[str, np.ndarray] = {}
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = x + U64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def join_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a pair of identifiers, order kept."""
    with np.errstate(over="ignore"):
        return mix(a * U64(_ODD) + b)


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of one of two multipliers, and of its inverse."""
    if len(_TABLES.get(f"pow{which}", ())) < n:
        size = max(1 << 18, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            for name, k in (("pow", _ODDS[which]), ("inv", pow(_ODDS[which], -1, 1 << 64))):
                t = np.full(size, k, dtype=U64)
                t[0] = 1
                _TABLES[f"{name}{which}"] = np.cumprod(t)
    return _TABLES[f"pow{which}"], _TABLES[f"inv{which}"]


#: A random 64-bit number for each byte value, for each multiplier.
BYTE_IDS = [mix(np.arange(1, 257, dtype=U64), salt) | U64(1) for salt in (7, 8)]


def prefixes(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial prefix sums mod 2**64 of a byte array, one longer than it."""
    power, _ = _powers(len(buf) + 1, which)
    out = np.zeros(len(buf) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_IDS[which][buf] * power[: len(buf)], out=out[1:])
    return out


def digests(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit digests of the byte strings [start, end), from prefixes()."""
    _, inverse = _powers(len(sums), which)
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * inverse[start])


def word_spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; is_word has a bool for each byte value."""
    flags = np.zeros(len(buf) + 2, dtype=np.int8)
    flags[1:-1] = is_word[buf]
    turn = np.diff(flags)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as a zstd frame of byte planes, of the differences if ascending."""
    x = np.ascontiguousarray(x).astype(U64, copy=False)
    if not len(x):
        return b""
    d = np.diff(x, prepend=U64(0)) if ascending else x
    planes = d.view(np.uint8).reshape(-1, 8).T
    top = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([top]) + zstandard.ZstdCompressor(level=1).compress(planes[:top].tobytes())


def unpack(data: bytes | None, ascending: bool = False) -> np.ndarray:
    """The inverse of pack()."""
    if not data:
        return np.empty(0, dtype=U64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = raw.T
    out = out.reshape(-1).view(U64)
    with np.errstate(over="ignore"):
        return np.cumsum(out, dtype=U64) if ascending else out


def pack_bits(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(x).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), count=n).astype(bool)


def runs(x: np.ndarray) -> np.ndarray:
    """Where a new value starts in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, dtype=np.int64)


def bucket_cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending 64-bit keys: the buckets (their top bits) that occur and the cuts between them."""
    if bits == 0 or not len(keys):
        return np.zeros(min(1, len(keys)), dtype=np.int64), np.array([0, len(keys)] if len(keys) else [0])
    top = (keys >> U64(64 - bits)).astype(np.int64)
    at = runs(top)
    return top[at], np.append(at, len(keys))

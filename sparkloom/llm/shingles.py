"""Keys of words and of word shingles for Arrow columns of text.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. Its key has 128 bits, as two numbers: those of up to 16 bytes
are mixed from the bytes themselves, so no two such words share a key; longer words have their BLAKE2b digest. A shingle's key is made
of those of its words, so different shingles share one by chance only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes of a text that are cut into words at once
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Breaks between words that are compared without punctuation: space and ASCII characters that are no letter or digit.
LOOSE = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the first k bytes of 8
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _keys(part: bytes) -> np.ndarray:
    """The keys of the words of some bytes, lower-cased before."""
    padded = np.frombuffer(part + bytes(16), np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[padded[: len(part)]], prepend=True, append=True))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.lib.stride_tricks.as_strided(padded.view("<u1")[:8].view("<u8"), shape=(len(padded) - 7,), strides=(1,))  # the 8 bytes from each place on
    low = eight[starts] & _MASKS[np.minimum(sizes, 8)]
    high = eight[starts + 8 * (sizes > 8)] & _MASKS[np.clip(sizes - 8, 0, 8)]
    out = np.empty((len(starts), 2), np.uint64)
    with np.errstate(over="ignore"):
        out[:, 0] = mix(mix(low) + high * _ODD + sizes.astype(np.uint64))
        out[:, 1] = mix(mix(high ^ _ODD) + low)
    for i in np.flatnonzero(sizes > 16):
        out[i] = np.frombuffer(hashlib.blake2b(part[starts[i] : starts[i] + sizes[i]], digest_size=16).digest(), "<u8")
    return out


def word_keys(text: bytes, breaks: bytes | None = None) -> np.ndarray:
    """The keys of a text's words, in order: uint64[words, 2]. breaks: a table that makes more bytes spaces (LOOSE)."""
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
        end = cut.start() if cut else len(text)
        part = text[at:end].lower()
        parts.append(_keys(part.translate(breaks) if breaks else part))
        at = end
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((0, 2), np.uint64)


def texts(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def shingle_sets(column, width: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct keys of its shingles, their first 64 bits and the others; of all its words, if there are fewer than width."""
    weights = mix(np.arange(1, 2 * width + 1, dtype=np.uint64).reshape(width, 2) * np.uint64(0x9E3779B97F4A7C55)) | np.uint64(1)
    for text in texts(column):
        keys = word_keys(text)
        size = min(len(keys), width)
        n = len(keys) - size + 1 if size else 0
        with np.errstate(over="ignore"):
            found = np.full((n, 2), size, np.uint64)
            for j in range(size):
                found += keys[j : j + n] * weights[j]
        found = mix(found)
        first, at = np.unique(found[:, 0], return_index=True)
        yield first, found[at, 1]

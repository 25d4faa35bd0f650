"""Words of many texts at once, as numpy arrays over their joined UTF-8 bytes.

Texts are joined by a byte that is in no word, so words never run from one text
into the next. Two word forms are in use: runs of digits, a-z and non-ASCII
after A-Z is lower-cased, and runs without ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text stands alone.
SLICE_BYTES = 1 << 20

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
LOWER_TABLE = LOWER.tobytes()
ALNUM = (_bytes >= 0x80) | ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | ((_bytes >= 0x41) & (_bytes <= 0x5A))
SOLID = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with their texts as bytes (null: empty), of about `limit` bytes each."""
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield batch.slice(first, i - first), texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield batch.slice(first), texts[first:]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLIER, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Words(NamedTuple):
    """blob: the joined, lower-cased bytes. starts, ends: of words in it. hashes: of words. first: for each text, its first word's number; one more at the end."""

    blob: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    text_starts: np.ndarray


def words_of(texts: list[bytes], kind: np.ndarray = ALNUM) -> Words:
    """The words of texts; kind says which bytes words are made of."""
    blob = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = kind[blob]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return Words(blob, starts, ends, hashes_of(blob, starts, ends), np.searchsorted(starts, text_starts), text_starts)


def hashes_of(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length: prefix sums of a polynomial, shifted to the word's start, then mixed."""
    n = len(blob)
    power, inverse = _powers(1 << max(20, int(n).bit_length()))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def leading(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as one number."""
    padded = np.concatenate([blob, np.zeros(8, np.uint8)])
    out = np.zeros(len(starts), np.uint64)
    for i in range(8):
        out |= np.where(starts + i < ends, padded[starts + i], 0).astype(np.uint64) << np.uint64(8 * i)
    return out

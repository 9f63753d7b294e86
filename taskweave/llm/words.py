"""Words and their hashes, for whole Arrow batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 19
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=_U)
    out[0] = 1
    filled = 1
    while filled < n:
        step = _U(pow(base, filled, 1 << 64))
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
    return out


class _Tables:
    """Powers of the hash base and of its inverse, made once in each Python worker."""

    forward = backward = None

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.forward is None or len(cls.forward) < n:
            n = max(n, 1 << 16)
            cls.forward, cls.backward = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        return cls.forward, cls.backward


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _byte_table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], dtype=bool)


#: Words of non-space bytes, and words of ASCII letters and digits or anything beyond ASCII.
SPACED = _byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LETTERED = _byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    """The words of several texts: of each, its text's number, its first byte, the byte after it and its hash.

    ``texts`` has where each text starts in ``data``, and the end; ``first`` has the number of each text's first word, and the end.
    """

    data: np.ndarray
    texts: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column without a copy, and where each text starts in them; a null is an empty text."""
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def scan(column: pa.Array, kind: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Cuts texts into words of the bytes that ``kind`` marks. ``lower``: A-Z count as a-z in the hashes."""
    data, texts = text_bytes(column)
    inside = kind[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    full = texts[:-1][texts[1:] > texts[:-1]]
    before[full] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[full[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, texts)
    text = np.repeat(np.arange(len(texts) - 1), np.diff(first))
    hashes = hash_words(data, start, end, lower) if hashed else np.zeros(0, dtype=_U)
    return Words(data, texts, start, end, text, hashes, first)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(start), dtype=_U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, side="right")))
            a, b = int(start[i]), int(end[j - 1])
            forward, backward = _Tables.upto(b - a + 1)
            piece = _LOWER[data[a:b]] if lower else data[a:b]
            sums = np.empty(b - a + 1, dtype=_U)
            sums[0] = 0
            np.cumsum((piece.astype(_U) + _U(1)) * forward[: b - a], out=sums[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * backward[s])
            i = j
    return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words, by where they begin; the caller drops those that cross a text's end."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(count, dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _U(_BASE) + hashes[k : k + count]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, and of one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j

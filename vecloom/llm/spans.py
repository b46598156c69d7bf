"""Vectorised work on texts as UTF-8 bytes: slices of Arrow columns, word boundaries, hashes of spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: Longer spans are hashed one at a time.
_LONG = 256

_U = np.uint64


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, row after the last, bytes, and where each text ends. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j
    del data, raw, column
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to stop of each span, eight bytes at a time."""
    length = stop - start
    out = mix(length.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    out = mix(out ^ (eight[start] & masks[np.minimum(length, 8)]))
    todo, done = np.flatnonzero((length > 8) & (length <= _LONG)), 8
    while len(todo):
        word = eight[start[todo] + done] & masks[np.minimum(length[todo] - done, 8)]
        out[todo] = mix(out[todo] * _U(0x9E3779B97F4A7C15) ^ word)
        done += 8
        todo = todo[length[todo] > done]
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """With A-Z made a-z, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text of the maximal runs of bytes for which the 256-entry table ``inside`` holds; none crosses texts."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    word = inside[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[np.concatenate([[0], ends])] = True
    begins = word & (first[:-1] | np.concatenate([[True], ~word[:-1]]))
    closes = word & (first[1:] | np.concatenate([~word[1:], [True]]))
    start, stop = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return start, stop, np.searchsorted(ends, start, side="right")


#: Bytes of words between white space.
NO_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Bytes of words of letters and figures: those of ASCII, and all beyond it.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words of a text, or of all its words if it has fewer, and their texts. Texts without words have none."""
    count = np.bincount(doc, minlength=n_docs)
    if len(words) >= n:
        whole = doc[: len(words) - n + 1] == doc[n - 1 :]
        h = words[: len(words) - n + 1]
        for k in range(1, n):
            h = mix(h * _U(0x9E3779B97F4A7C15) ^ words[k : len(words) - n + 1 + k])
        h, at = h[whole], doc[: len(words) - n + 1][whole]
    else:
        h, at = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.cumsum(count) - count
        own = []
        for d in short.tolist():
            x = words[first[d] : first[d] + 1] + _U(int(count[d]))
            for k in range(1, int(count[d])):
                x = mix(x * _U(0x9E3779B97F4A7C15) ^ words[first[d] + k : first[d] + k + 1])
            own.append(mix(x))
        h, at = np.concatenate([h, *own]), np.concatenate([at, short])
    return h, at

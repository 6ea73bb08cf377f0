"""Vectorised word and span hashes over Arrow text batches."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)
LANE = 8
LONG_WORD = 256
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(LANE + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start:end of each word, equal for equal bytes wherever they stand.

    Words are taken in lanes of 8 bytes, each mixed in turn, so unlike a sum of powers no regular pattern of letters
    cancels out; words of more than LONG_WORD bytes go by their BLAKE2 digest.
    """
    length = end - start
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(LANE, np.uint8)]), strides=(1,))
    h = mix(length.astype(np.uint64) * STEP)
    at, left, which = start, length, slice(None)
    for _ in range(LONG_WORD // LANE):
        h[which] = mix(h[which] ^ (lanes[at] & KEEP[np.minimum(left, LANE)]))
        more = np.flatnonzero(left > LANE)
        if not len(more):
            break
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + LANE, left[more] - LANE
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def run_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of words[start:end] for each of adjacent runs, none empty: a sum of words mixed with their places in the run."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(len(words)) - np.repeat(start, np.diff(np.append(start, len(words))))
    salt = mix(np.array([lane + 1], np.uint64) * STEP)[0]
    sums = np.add.reduceat(mix(words + mix(place.astype(np.uint64) * STEP + salt)), start)
    return mix(sums + mix((end - start).astype(np.uint64) ^ salt))


def flat_bytes(texts: pa.Array, gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in a row with `gap` zero bytes before each; start and end of each. Null: empty."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(bytes(gap) + bytes(gap).join(raw), np.uint8)
    starts = gap + np.cumsum(lens + gap) - lens - gap
    return data, starts, starts + lens


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the flat texts, and the bounds of each text's words among them.

    Between the texts stand zero bytes, which part words there; a zero byte in a text is a word's byte.
    """
    inside = ~SPACE[data]
    gaps = np.ones(len(data) + 1, np.int8)
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    gaps = np.cumsum(step[:-1]) > 0
    inside &= gaps
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([np.searchsorted(ws, starts), [len(ws)]])
    return ws, we, bounds


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted set of hashes of the k-word shingles of each text, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle, a text without words (or null) none.
    """
    data, starts, ends = flat_bytes(texts)
    ws, we, bounds = word_spans(data, starts, ends)
    words = word_hashes(FOLD[data], ws, we)
    count = max(0, len(words) - k + 1)
    h = np.zeros(count, np.uint64)
    for j in range(k):
        h = mix(h + words[j : j + count])  # in turn, so that the order of the words tells
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(run_hashes(words[a:b], np.array([0]), np.array([b - a]), k))
        else:
            out.append(h[:0])
    return out


def by_bytes(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each, at least a row each."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def sized(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text each: small ones are joined, large ones cut."""
    held, size = [], 0
    for batch in batches:
        for a, b in by_bytes(batch.column(column), most):
            held.append(batch.slice(a, b - a))
            size += pc.sum(pc.binary_length(held[-1].column(column))).as_py() or 0
            if size >= most // 2 or sum(x.num_rows for x in held) >= 20_000:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    held.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, and later tasks may need other sizes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)

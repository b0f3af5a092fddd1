"""Vectorised scanning of UTF-8 text: words, word hashes and n-gram hashes without a Python object per word.

A batch of texts is one byte buffer with offsets. A polynomial prefix sum over the buffer (arithmetic modulo 2**64
with an odd base, which has an inverse) gives the hash of any byte range in constant time, so all words of a
batch are hashed by a few NumPy passes. Scratch memory is about 40 bytes a byte of input; ``slices`` bounds it by
cutting batches at ``SLICE_BYTES``. A single text longer than that forms a slice of its own.

Words made for it can collide under a polynomial; where equality decides a result, ``word_digests`` mixes words
block by block instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Space and the five ASCII controls that end a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least; kept and doubled as texts get longer."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications, a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets where each begins (nulls are empty)."""
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, of one row at least."""
    if not len(texts):
        return
    at = buffers(texts)[1]
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(at, at[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop


def ranges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, as maximal runs without ASCII white space inside one text: starts, ends, first word of each text."""
    solid = np.zeros(len(raw) + 1, np.int8)
    solid[:-1] = ~IS_SPACE[raw]
    step = np.diff(solid, prepend=np.int8(0))
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(raw))])
    cut = cut[(solid[cut] == 1) & (solid[cut - 1] == 1)]
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    if len(cut):
        starts = np.sort(np.concatenate([starts, cut]))
        ends = np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(raw: np.ndarray) -> np.ndarray:
    """Sums P with P[j] - P[i] = sum of (byte + 1) * BASE**k over k in i..j-1."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


_SHORT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
LONG_WORD = 512


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of words: their length, then each 8 bytes, mixed into a state; of words over ``LONG_WORD`` bytes BLAKE2."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, state, left, which = starts, out, size, np.arange(len(starts))
    while len(which):
        block = eights[at] & _SHORT[np.minimum(left, 8)]
        state = mix((state ^ block) * np.uint64(0x9E6C63D0676A9A99) + np.uint64(0x243F6A8885A308D3))
        done = (left <= 8) | (size[which] > LONG_WORD)
        out[which[done]] = state[done]
        at, state, left, which = at[~done] + 8, state[~done], left[~done] - 8, which[~done]
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = int.from_bytes(blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def text_hash(word: str) -> int:
    """The hash that ``range_hash`` gives to these bytes."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(range_hash(prefix(raw), np.array([0]), np.array([len(raw)]))[0])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` words in a text, and their bounds by text; shorter texts are one shingle."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(first[:-1], n)
    room = np.repeat(np.minimum(counts, width), n)
    out = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        nxt = mix(out * np.uint64(0x9E6C63D0676A9A99) + padded[at + k])
        out = nxt if (room > k).all() else np.where(room > k, nxt, out)
    return out, bounds


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... for each i, one range after the other."""
    total = np.cumsum(lengths)
    out = np.ones(int(total[-1]) if len(total) else 0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if len(starts):
        head = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out[head] = starts
        out[head[1:]] -= starts[:-1] + lengths[:-1] - 1
        np.cumsum(out, out=out)
    return out

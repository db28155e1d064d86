"""Words and word shingles of whole batches of texts, hashed to 64 bits over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from inkwell.llm.common import SPACES

_U = np.uint64
#: Odd multipliers; any would do, they only have to stay the same.
_BASE, _M1, _M2, _STEP = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class Words(NamedTuple):
    """The words of a batch, text after text: hash, first byte and end within data; first word of each text, and the number of words."""

    data: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    count: np.ndarray


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after another, and where each begins, with the end of the last."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(texts: pa.Array, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that are inside words; first run of each text, and the number of runs. A null text has none."""
    if texts.null_count:  # what lies under a null doesn't count
        inside = inside.copy()
        for i in np.flatnonzero(np.asarray(texts.is_null())):
            inside[offsets[i] : offsets[i + 1]] = False
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(begins, offsets[:-1])
    return begins, ends, first, np.diff(np.append(first, len(begins)))


def words_of(texts: pa.Array, lower: bool = True, parts=None) -> Words:
    """Words are maximal runs of bytes other than the spaces; A-Z count as a-z. A null text has no words.

    parts: a function of the bytes, giving those that count as theirs (lower case) and which of them are inside words.
    """
    raw, offsets = raw_bytes(texts)
    if parts:
        data, inside = parts(raw)
    else:
        data = _LOWER[raw] if lower else raw
        inside = ~_SPACE[data]
    begins, ends, first, count = runs_of(texts, inside, offsets)
    return Words(data, hashed(data, begins, ends), begins, ends, first, count)


#: Powers of the base and of its inverse modulo 2^64, made once.
BLOCK = 1 << 18
_POWERS = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(BLOCK, _BASE))))
_INVERSE = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(BLOCK, _U(pow(int(_BASE), -1, 1 << 64))))))


def hashed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of each word, ends in rising order, from prefix sums over blocks of bytes; a word longer than a block is summed block by block."""
    out = np.zeros(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        low = int(begins[at])
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = int(ends[to - 1])
        if high - low <= BLOCK:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + _U(1)) * _POWERS[: high - low], out=sums[1:])
            b = begins[at:to] - low
            out[at:to] = (sums[ends[at:to] - low] - sums[b]) * _INVERSE[b]
        else:
            whole, power, wrap = 0, 1, (1 << 64) - 1
            for k in range(low, high, BLOCK):
                part = data[k : min(high, k + BLOCK)].astype(np.uint64) + _U(1)
                whole = whole + int(np.add.reduce(part * _POWERS[: len(part)])) * power & wrap
                power = power * int(_POWERS[BLOCK]) & wrap
            out[at] = whole
        at = to
    return mixed(out + (ends - begins).astype(np.uint64) * _STEP)


def slices(texts: pa.Array, most: int = 1 << 21) -> list[tuple[int, pa.Array]]:
    """A batch in runs of texts of about `most` bytes, each with the place where it begins; bounds what a worker holds."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return [(0, texts)]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    out, at = [], 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        out.append((at, texts.slice(at, to - at)))
        at = to
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size items; a run over the border of two texts is among them."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        out = (out + hashes[k : k + len(out)]) * _STEP
    return mixed(out + _U(size))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; of a text with fewer words, one of them all; without words, none."""
    for _, some in slices(texts):
        words = words_of(some)
        runs = windows(words.hashes, size)
        for at, n in zip(words.first.tolist(), words.count.tolist(), strict=True):
            if n >= size:
                yield np.unique(runs[at : at + n - size + 1])
            else:
                yield windows(words.hashes[at : at + n], n) if n else np.zeros(0, np.uint64)

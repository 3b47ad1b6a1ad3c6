"""Words of whole texts as 64-bit hashes, found on the UTF-8 bytes with numpy.

Both word rules in use separate words by ASCII characters only, so no character is decoded:
ALNUM keeps digits, letters and everything beyond ASCII; BLANKS keeps everything but white space.
A-Z counts as a-z. The texts of many rows are handled at once, in windows of bounded size, however
long a single text is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)

_code = np.arange(256)
ALNUM = (_code >= 0x80) | ((_code >= 0x30) & (_code <= 0x39)) | ((_code >= 0x41) & (_code <= 0x5A)) | ((_code >= 0x61) & (_code <= 0x7A))
BLANKS = ~((_code == 0x20) | ((_code >= 0x09) & (_code <= 0x0D)))
LOWER = np.where((_code >= 0x41) & (_code <= 0x5A), _code + 32, _code).astype(np.uint8)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_VALUE = _BYTE[LOWER]
_POWERS = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        steps = np.full(max(n, 2 * len(_POWERS), 64), 0x100000001B3, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


@dataclass
class Words:
    start: np.ndarray  #: byte offset of each word
    end: np.ndarray
    row: np.ndarray  #: index of its text
    hash: np.ndarray
    bounds: np.ndarray  #: the words of text i are bounds[i]:bounds[i + 1]


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, *, lower: bool = True) -> Words:
    """All words of the texts data[offsets[i]:offsets[i + 1]]; lower: words that differ in A-Z alone hash alike."""
    values = _VALUE if lower else _BYTE
    starts, ends, hashes, lo, n = [], [], [], 0, len(data)
    while lo < n:
        hi = min(lo + WINDOW, n)
        if hi < n:  # end after a separator, or else with the word
            back = np.flatnonzero(~kept[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:
                while hi < n and kept[data[hi]]:
                    step = np.flatnonzero(~kept[data[hi : hi + WINDOW]])
                    hi = min(n, hi + (int(step[0]) if len(step) else WINDOW))
        chunk = data[lo:hi]
        inside = kept[chunk]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first[cuts] = inside[cuts]
        s = np.flatnonzero(first)
        if len(s):
            at = np.flatnonzero(inside)
            order = np.searchsorted(at, s)
            length = np.diff(np.append(order, len(at)))
            place = np.arange(len(at)) - np.repeat(order, length)
            value = values[chunk[at]] * powers(int(length.max()))[place]
            starts.append(s + lo)
            ends.append(s + lo + length)
            hashes.append(mixed(np.add.reduceat(value, order) + length.astype(np.uint64) * _ODD))
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(start, offsets)
    return Words(start, np.concatenate(ends) if ends else start, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), bounds)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` hashes, by its first place."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, length):
        out *= _ODD
        out += hashes[j : j + n]
    return mixed(out)


def text_words(text: str, kept: np.ndarray) -> list[bytes]:
    """The words of one text, as lower-case bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = words(data, np.array([0, len(data)]), kept)
    low = LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]

"""Content-defined anchors of byte strings: every long string has one, and equal strings have equal ones."""

from __future__ import annotations

import numpy as np

GRAM = 24
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def grams(data: bytes) -> np.ndarray:
    """A 64-bit name for the q-gram of GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    word = lambda at: np.ndarray((n,), "<u8", data, at, (1,))
    out = word(0) * _C[0]
    for i in (1, 2):
        out = _mix(out) + word(8 * i) * _C[i]
    return _mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    got = 1
    while got < width:
        step = min(got, width - got)
        x = np.minimum(x[:-step], x[step:])
        got += step
    return x


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, start, count): for each anchor its q-gram's name and the run of strings of ``length`` bytes it stands for.

    A string's anchor is the leftmost of its q-grams with the smallest name, so equal strings have their anchor at
    the same place, and the strings of an anchor start side by side.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = b"".join(texts)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    names = grams(data)
    keys = (names & ~_LOW) | np.arange(len(names), dtype=np.uint64)
    least = (sliding_min(keys, length - GRAM + 1) & _LOW).astype(np.int64)
    fits = np.zeros(len(least) + 1, np.int8)
    own = sizes >= length
    np.add.at(fits, starts[:-1][own], 1)
    np.add.at(fits, starts[1:][own] - length + 1, -1)
    ok = np.cumsum(fits[:-1], dtype=np.int8) > 0
    fresh = ok.copy()
    fresh[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(fresh)
    stop = ok.copy()
    stop[:-1] &= ~ok[1:] | (least[1:] != least[:-1])
    # a run of one text that ends where the next text's begins is two runs: texts end with length - 1 places that do not fit
    count = np.flatnonzero(stop) - first + 1
    text = np.searchsorted(starts, first, "right") - 1
    return text, names[least[first]].view(np.int64), first - starts[text], count

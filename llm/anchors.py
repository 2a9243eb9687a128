"""Anchors: places in byte strings that any two equal stretches of ``length`` bytes choose alike."""

from __future__ import annotations

import numpy as np

from . import textkit as K

#: Bits of a place within a block, in the low end of the keys whose minimum is sought.
PLACE = 24


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i that has as many."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) of the anchors of all stretches of ``length`` bytes that lie within one document.

    A stretch's anchor is the gram of least hash in it, the leftmost of equals. first and last: the starts of the
    stretches that have this anchor. offsets: relative to data.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, np.zeros(0, np.uint64), none, none
    if len(data) >= 1 << PLACE:
        raise ValueError("cut a text this long before")
    s = K.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = K.mix((s[gram:] - s[:-gram]) * K.powers(len(s))[1][: len(at)])
    keys = (h & ~np.uint64((1 << PLACE) - 1)) | at.astype(np.uint64)
    chosen = (sliding_min(keys, length - gram + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    # stretches that lie within one document
    whole = np.ones(len(chosen) + length, np.int8)
    for d in range(len(offsets) - 1):
        whole[max(offsets[d], offsets[d + 1] - length + 1) : offsets[d + 1]] = 0
    start = np.flatnonzero(whole[: len(chosen)])
    chosen = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    run = np.flatnonzero(new)
    last = np.append(run[1:], len(start)) - 1 if len(run) else run
    return chosen[run], h[chosen[run]], start[run], start[last]

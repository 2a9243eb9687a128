"""Deep-shallow sorting of equally long byte strings.

Shallow: multikey quicksort, whose characters are words of eight bytes, to a depth of ``SHALLOW`` bytes. Each open group takes a pivot, the median of
its first, middle and last string's word, and parts into less, equal and more; only the equal ones go on to the next word. All groups
take a step together, one stable sort of small numbers a step.

Deep: a group that is still tied, mostly a long common prefix, is ordered by a blind trie. A path of the trie is named by a leader, one of its
strings; a string that leaves the path is known by its branch alone, the place of its first difference from the leader and the byte there, and
strings of one branch share a path below it. Each string is compared once with the leader of each path that it takes, from the path's beginning on, and
equal ones end at one leaf. Read in order of branches, the trie gives the sorted strings.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def word_at(data: np.ndarray, start: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
    """The eight bytes at depth of each string, as numbers that order alike."""
    at = start + depth
    out = np.zeros(len(start), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k].astype(np.uint64)
    return out


def _starts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each group, and the group of each place."""
    return np.flatnonzero(new), np.cumsum(new) - 1


def _quicksort(data: np.ndarray, start: np.ndarray, order: np.ndarray, new: np.ndarray, deepest: int) -> None:
    """Multikey quicksort of the groups that new marks in order, in place, to a depth of deepest bytes."""
    open_ = np.arange(len(order))  # places of groups that aren't done
    word, depth = word_at(data, start[order], 0), np.zeros(len(order), np.int64)  # by place
    while True:
        first, group = _starts(new[open_])
        size = np.diff(np.append(first, len(open_)))
        going = np.repeat((size > 1) & (depth[open_[first]] < deepest), size) if len(first) else np.zeros(0, bool)
        open_ = open_[going]
        if not len(open_):
            return
        first, group = _starts(new[open_])
        size = np.diff(np.append(first, len(open_)))
        own = word[open_]
        low, mid, high = own[first], own[first + size // 2], own[first + size - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))[group]
        side = group * 3 + 1 + (own > pivot) - (own < pivot)
        step = np.argsort(side, kind="stable")
        side = side[step]
        order[open_], word[open_] = order[open_[step]], own[step]
        new[open_[1:]] = side[1:] != side[:-1]
        equal = open_[side % 3 == 1]
        depth[equal] += 8
        deeper = equal[depth[equal] < deepest]
        word[deeper] = word_at(data, start[order[deeper]], depth[deeper])


def _blind_tries(data: np.ndarray, start: np.ndarray, order: np.ndarray, new: np.ndarray, length: int, depths: list[int]) -> None:
    """Orders the tied groups that new marks by blind tries, in place."""
    first, group = _starts(new)
    open_ = np.flatnonzero(np.bincount(group)[group] > 1)
    begins = np.full(len(order), depths[0] if depths else length)  # by place: its path's strings are equal up to here
    while len(open_) and depths:
        head, group = _starts(new[open_])
        leader = order[open_[head]][group]
        own = order[open_]
        branch = np.full(len(open_), EQUAL, np.int64)  # which way a string leaves the leader's path; in order of strings
        place = np.full(len(open_), length, np.int64)
        on = np.arange(len(open_))
        for d in depths:
            if not len(on):
                break
            here = begins[open_[on]] < d + 8
            some = on[here]
            a, b = word_at(data, start[own[some]], d), word_at(data, start[leader[some]], d)
            off = a != b
            x = (a ^ b)[off]
            left = some[off]
            byte = 7 - (_top_bit(x) >> 3)
            value = ((a[off] >> ((7 - byte) << 3).astype(np.uint64)) & np.uint64(255)).astype(np.int64)
            place[left] = d + byte
            # less than the leader: the sooner it leaves the earlier; more: the later
            branch[left] = np.where(a[off] < b[off], (place[left] << 8) | value, EQUAL + 1 + ((length - place[left]) << 8) + value)
            gone = np.zeros(len(open_), bool)
            gone[left] = True
            on = on[~gone[on]]
        step = np.lexsort((branch, group))
        branch, group, place = branch[step], group[step], place[step]
        order[open_] = own[step]
        begins[open_] = place + 1
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (branch[1:] != branch[:-1])
        new[open_] |= fresh
        first, group = _starts(fresh)
        size = np.diff(np.append(first, len(open_)))
        open_ = open_[np.repeat((branch[first] != EQUAL) & (size > 1), size)]


def sort_strings(data: np.ndarray, start: np.ndarray, length: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of data[s : s + length] for s in start, and for each string in order the number of its class of equals.

    group: numbers known to differ for strings that differ; strings are then ordered within each of them. Strings have eight bytes or more.
    """
    n = len(start)
    if length < 8:
        raise ValueError("strings of eight bytes or more")
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    order = np.arange(n)
    if group is not None:
        order = np.argsort(group, kind="stable")
        new[1:] = group[order][1:] != group[order][:-1]
    shallow = min(SHALLOW, length // 8 * 8)
    _quicksort(data, start, order, new, shallow)
    deep = list(range(shallow, length - 7, 8))
    if length % 8:
        deep.append(length - 8)
    _blind_tries(data, start, order, new, length, deep)
    return order, np.cumsum(new) - 1


EQUAL = 1 << 24


def _top_bit(x: np.ndarray) -> np.ndarray:
    """Place of the highest bit set."""
    out = np.zeros(len(x), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(step)
        some = high != 0
        out[some] += step
        x = np.where(some, high, x)
    return out

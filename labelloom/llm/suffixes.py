"""Suffix sorting of many short stretches: shallow multikey quicksort, then blind tries."""

from __future__ import annotations

import numpy as np

_LETTER = 8  # bytes that one step of the quicksort looks at


def letters(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as a view; the first byte is the lowest."""
    return np.ndarray((max(0, len(text) - _LETTER + 1),), "<u8", buffer=text, strides=(1,))


def _tied(pos: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of slots in order, those in a run of ``same`` neighbours, and their run's number.

    ``same[i]``: slot i continues the run of slot i - 1.
    """
    run = np.cumsum(~same) - 1
    keep = np.bincount(run)[run] > 1
    return pos[keep], np.unique(run[keep], return_inverse=True)[1]


def suffix_sort(
    text: np.ndarray, starts: np.ndarray, length: int = 50, shallow: int = 16
) -> tuple[np.ndarray, np.ndarray]:
    """Order the strings ``text[s : s + length]`` of ``starts``.

    Returns the order as indices into ``starts``, and for each place in it whether its
    string differs from the one before. ``shallow`` is a multiple of 8, at most
    ``length - 8``. Multikey quicksort splits all strings by eight bytes at a time to the
    shallow depth. A group that is still tied is entered in a blind trie along the path of
    its first string: every other string is compared with that one leaf in full and hangs
    off the path at the depth and byte where it departs; strings that depart together are
    the next, smaller groups. All groups go on at the same time.
    """
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    view = letters(text)
    first = view[starts].byteswap()
    order = np.argsort(first, kind="quicksort")
    first = first[order]
    same = np.r_[False, first[1:] == first[:-1]]
    fresh = ~same
    pos, group = _tied(np.arange(n), same)
    for depth in range(_LETTER, shallow, _LETTER):
        letter = view[starts[order[pos]] + depth].byteswap()
        by = np.lexsort((letter, group))
        order[pos] = order[pos][by]
        letter, group = letter[by], group[by]
        same = np.r_[False, (group[1:] == group[:-1]) & (letter[1:] == letter[:-1])] if len(pos) else np.zeros(0, bool)
        fresh[pos] |= ~same
        pos, group = _tied(pos, same)
    steps = [*range(shallow, length - _LETTER, _LETTER), length - _LETTER]
    while len(pos):
        members = starts[order[pos]]
        leaf = members[np.r_[True, group[1:] != group[:-1]]][group]
        common = np.full(len(pos), length)
        left = np.arange(len(pos))
        for depth in steps:
            apart = view[members[left] + depth] ^ view[leaf[left] + depth]
            some = apart != 0
            low = apart[some] & (~apart[some] + np.uint64(1))
            common[left[some]] = depth + np.log2(low.astype(np.float64)).astype(np.int64) // 8
            left = left[~some]
        at = np.minimum(common, length - 1)
        byte, own = text[members + at].astype(np.int64), text[leaf + at]
        side = np.where(common == length, 0, np.where(byte < own, -1, 1))
        # Before the leaf the early departures come first, behind it the late ones.
        place = np.where(side < 0, common, np.where(side > 0, length - common, 0))
        key = (((group * 3 + side + 1) * (length + 1)) + place) * 256 + np.where(side == 0, 0, byte)
        by = np.argsort(key, kind="stable")
        order[pos] = order[pos][by]
        key, side = key[by], side[by]
        same = np.r_[False, key[1:] == key[:-1]]
        fresh[pos] |= ~same
        # Strings equal to their leaf are in place.
        rest = side != 0
        pos, group = _tied(pos[rest], same[rest])
    return order, fresh

"""Suffix sorting by linear grouping.

Suffixes with the same Lyndon prefix form a group. Groups are processed from the highest down: each of its suffixes
points to the nearest earlier suffix of a smaller group, and the suffixes pointed at move into new groups just
above their own, the more pointers the higher. When all are processed, one scan emits the suffixes in order:
a placed suffix places the chain of those that precede it. No rank is ever renamed recursively.
"""

from __future__ import annotations

from array import array

import numpy as np


def _integers(values: np.ndarray) -> array:
    return array("i", values.astype(np.int32).tobytes())


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of an integer sequence, in ascending order."""
    count = len(symbols)
    if not count:
        return np.zeros(0, np.int64)
    # A smallest symbol at the end, in front of all others.
    codes = np.append(np.unique(symbols, return_inverse=True)[1] + 1, 0)
    size = count + 1
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    tails = np.append(heads[1:], size)
    # A group is named by the first place its suffixes will take; `end_of` gives the group that ends at a place.
    group = heads[np.searchsorted(heads, np.arange(size), side="right") - 1]
    named = np.empty(size, np.int64)
    named[order] = group
    # Flat arrays of machine integers: lists would take ten times their memory.
    group_of = _integers(named)
    first_end, group_ending = array("i", bytes(4 * size)), array("i", bytes(4 * (size + 1)))
    for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
        first_end[head], group_ending[tail] = tail, head
    group_end = first_end[:]
    members: dict[int, list[int]] = {}  # of groups that were formed later
    previous = array("i", [-1]) * size

    place = size
    while place > 0:
        head = group_ending[place]
        pointed: dict[int, int] = {}
        own = members.pop(head, None)
        for suffix in order[head : first_end[head]].tolist() if own is None else own:
            if group_of[suffix] != head:
                continue  # moved to a higher group
            before = suffix - 1
            while before >= 0 and group_of[before] >= head:
                before = previous[before]
            previous[suffix] = before
            if before >= 0:
                pointed[before] = pointed.get(before, 0) + 1
        if pointed:
            moves: dict[tuple[int, int], list[int]] = {}
            for suffix, pointers in pointed.items():
                moves.setdefault((pointers, group_of[suffix]), []).append(suffix)
            for (_, old), moved in sorted(moves.items(), reverse=True):
                end = group_end[old]
                new = end - len(moved)
                if new == old:
                    continue  # the whole group moves: it stays where it is
                moved.sort()
                members[new] = moved
                for suffix in moved:
                    group_of[suffix] = new
                group_end[old], group_end[new] = new, end
                group_ending[new], group_ending[end] = old, new
        place = head

    out = array("i", bytes(4 * size))
    placed = bytearray(size)
    next_free = array("i", range(size))
    out[0] = count
    placed[count] = 1
    for at in range(size):
        suffix = out[at] - 1
        while suffix >= 0 and not placed[suffix]:
            head = group_of[suffix]
            slot = next_free[head]
            next_free[head] = slot + 1
            out[slot] = suffix
            placed[suffix] = 1
            suffix = previous[suffix]
    return np.array(out[1:], np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` and the one before it; 0 for the first."""
    text, count = array("q", symbols.astype("<i8").tobytes()), len(symbols)
    places = np.empty(count, np.int64)
    places[order] = np.arange(count)
    sorted_at, rank = _integers(order), _integers(places)
    out, length = array("i", bytes(4 * count)), 0
    for start in range(count):
        if rank[start]:
            other = sorted_at[rank[start] - 1]
            limit = count - max(start, other)
            while length < limit and text[start + length] == text[other + length]:
                length += 1
            out[rank[start]] = length
            length = max(length - 1, 0)
        else:
            length = 0
    return np.array(out, np.int64)

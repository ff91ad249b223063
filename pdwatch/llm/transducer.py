"""Weighted acyclic automata over sequences of symbols: each path is an n-gram, the weight of its last arc its count.

Built from sorted n-grams, block after block. As soon as the n-grams have passed a state, it is frozen: a state with the
same arcs (label, weight, target) that exists already takes its place. States and arcs are arrays, one set a level; the
first level reads a group symbol (a language), the others words.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Sequence
from itertools import pairwise

import numpy as np

from pdwatch.llm.common import expanded, squeezed

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: N-grams that a builder takes in at once.
BLOCK = 1 << 19


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _M2
    return values ^ (values >> np.uint64(29))


def sorted_keys(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the n-grams and where in that order a new one begins. Columns hold numbers below 2^32."""
    width = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(width) <= 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for column, bits in zip(columns, width, strict=True):
            key = (key << np.uint64(bits)) | column.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(max(len(order) - 1, 0), bool)
        for column in columns:
            new |= np.diff(column[order].astype(np.int64)) != 0
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(order), 1), bool), new]))


def combined(columns: Sequence[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams, sorted, with the sum of their weights; without weights with their number."""
    width = [int(c.max(initial=0)).bit_length() for c in columns]
    most = 0 if weights is None else int(weights.max(initial=0)).bit_length()
    if not len(columns[0]) or sum(width) + most > 64:
        weights = np.ones(len(columns[0]), np.int64) if weights is None else weights
        order, first = sorted_keys(columns)
        if not len(order):
            return list(columns), weights
        return [c[order[first]] for c in columns], np.add.reduceat(weights[order], first)
    # N-gram and weight are one number: plain numbers sort many times faster than positions.
    key = np.zeros(len(columns[0]), np.uint64)
    for column, bits in zip(columns, width, strict=True):
        key <<= np.uint64(bits)
        key |= column.astype(np.uint64)
    if weights is not None:
        key <<= np.uint64(most)
        key |= weights.astype(np.uint64)
    key.sort()
    gram = key if weights is None else key >> np.uint64(most)
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    if weights is None:
        total = np.diff(np.append(first, len(gram)))
    else:
        total = np.add.reduceat((key & np.uint64((1 << most) - 1)).astype(np.int64), first)
    gram, found = gram[first], []
    for column, bits in zip(columns[::-1], width[::-1], strict=True):
        found.append((gram & np.uint64((1 << bits) - 1)).astype(column.dtype))
        gram = gram >> np.uint64(bits)
    return found[::-1], total


class _Level:
    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.states = 0
        self.known = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.numbers = np.zeros(0, np.int64)

    def freeze(self, widths: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Numbers of states given by their arcs; only unknown ones are added. Equal up to 128-bit hashes."""
        start = np.concatenate([[0], np.cumsum(widths)])[:-1].astype(np.int64)
        arcs = _mix(label.astype(np.uint64) * _M1 + _mix(weight.astype(np.uint64) + _mix(target.astype(np.uint64) + _M1)))
        name, check = np.add.reduceat(arcs, start), np.add.reduceat(_mix(arcs * _M1), start)
        _, first, of = np.unique(name, return_index=True, return_inverse=True)
        # A state whose second hash differs from that of its namesake stays its own.
        twin = np.where(check == check[first][of], first[of], np.arange(len(name)))
        at = np.searchsorted(self.known, name)
        known = np.zeros(len(name), bool)
        if len(self.known):
            inside = np.minimum(at, len(self.known) - 1)
            known = (self.known[inside] == name) & (self.checks[inside] == check)
        added = (twin == np.arange(len(name))) & ~known
        number = np.full(len(name), -1, np.int64)
        if known.any():
            number[known] = self.numbers[at[known]]
        number[added] = self.states + np.arange(int(added.sum()))
        self.states += int(added.sum())
        keep = np.repeat(added, widths)
        self.parts.append((widths[added], label[keep], weight[keep], target[keep]))
        names = np.concatenate([self.known, name[added]])
        order = np.argsort(names, kind="stable")
        self.known = names[order]
        self.checks = np.concatenate([self.checks, check[added]])[order]
        self.numbers = np.concatenate([self.numbers, number[added]])[order]
        return np.where(known, number, number[twin])

    def arrays(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 3)
        widths, *rest = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        return (np.concatenate([[0], np.cumsum(widths)]).astype(np.int64), *rest)


class Transducer:
    """`groups` and `words` are the sorted symbols; `levels` the arrays start, label, weight and target of each level."""

    def __init__(self, groups: list[bytes], words: list[bytes], levels: list[tuple[np.ndarray, ...]]) -> None:
        self.groups, self.words, self.levels = groups, words, levels

    @classmethod
    def build(cls, groups: list[bytes], words: list[bytes], columns: Sequence[np.ndarray], weights: np.ndarray) -> Transducer:
        """From sorted, distinct n-grams: numbers of symbols from 1 on, 0 where an n-gram has ended."""
        depth = len(columns)
        levels = [_Level() for _ in range(depth)]
        head: list[tuple[np.ndarray, ...]] = []
        size = len(weights)
        change = np.ones(size, bool)
        change[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        cuts = np.flatnonzero(change)
        start = 0
        while start < size:
            # A block ends where a first word ends, so that its states are passed.
            place = np.searchsorted(cuts, start + BLOCK)
            end = int(cuts[place]) if place < len(cuts) else size
            head.append(cls._block(levels, [c[start:end] for c in columns], weights[start:end]))
            start = end
        if head:
            group, label, weight, target = (np.concatenate([h[k] for h in head]) for k in range(4))
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            widths = np.diff(np.append(first, len(group)))
            states = levels[1].freeze(widths, label, weight, target)
            levels[0].freeze(np.array([len(first)]), group[first], np.zeros(len(first), np.int64), states)
        return cls(groups, words, [level.arrays() for level in levels])

    @staticmethod
    def _block(levels: list[_Level], columns: Sequence[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, ...]:
        depth, size = len(columns), len(weights)
        differs, rows = np.zeros(size, bool), []
        differs[0] = True
        for d in range(depth):
            differs = differs.copy()
            differs[1:] |= columns[d][1:] != columns[d][:-1]
            rows.append(differs & (columns[d] > 0))
        below = None
        for d in range(depth - 1, 0, -1):
            at = np.flatnonzero(rows[d])
            ends = columns[d + 1][at] == 0 if d + 1 < depth else np.ones(len(at), bool)
            weight = np.where(ends, weights[at], 0)
            target = np.full(len(at), -1, np.int64)
            if below is not None:
                parents, states = below
                # The arc that leads to a parent is the last one before its first child.
                target[np.searchsorted(at, parents, side="right") - 1] = states
            label = columns[d][at].astype(np.int64)
            if d == 1:
                return columns[0][at].astype(np.int64), label, weight, target
            if len(at):
                parent = np.cumsum(rows[d - 1])[at]
                first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
                below = at[first], levels[d].freeze(np.diff(np.append(first, len(at))), label, weight, target)
            else:
                below = None
        raise AssertionError("an n-gram has a group and a word")

    def entries(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All n-grams with a weight, in columns as `build` takes them, and the weights; not sorted."""
        depth = len(self.levels)
        found: list[list[np.ndarray]] = [[] for _ in range(depth)]
        weights = []
        path: list[np.ndarray] = []
        states = np.zeros(min(1, len(self.levels[0][0]) - 1), np.int64)
        for d, (start, label, weight, target) in enumerate(self.levels):
            widths = start[states + 1] - start[states]
            back = np.repeat(np.arange(len(states)), widths)
            arcs = np.repeat(start[states] - np.cumsum(widths) + widths, widths) + np.arange(len(back))
            path = [p[back] for p in path] + [label[arcs]]
            held = weight[arcs] > 0
            for k in range(depth):
                found[k].append(path[k][held] if k <= d else np.zeros(int(held.sum()), np.int64))
            weights.append(weight[arcs][held])
            on = target[arcs] >= 0
            path, states = [p[on] for p in path], target[arcs][on]
        return [np.concatenate(f) for f in found], np.concatenate(weights)

    @functools.cached_property
    def numbers(self) -> tuple[dict[bytes, int], dict[bytes, int]]:
        """The numbers of the groups and words. Made once, however many transducers are composed with this one."""
        return tuple({symbol: n for n, symbol in enumerate(symbols, 1)} for symbols in (self.groups, self.words))

    @functools.cached_property
    def arcs(self) -> list[np.ndarray]:
        """For each level the arcs as one sorted number each, of the state and the label. Made once like `numbers`."""
        sizes = [len(self.groups) + 1] + [len(self.words) + 1] * (len(self.levels) - 1)
        return [
            np.repeat(np.arange(len(start) - 1), np.diff(start)) * size + label
            for size, (start, label, _, _) in zip(sizes, self.levels, strict=True)
        ]

    def composed(self, other: Transducer) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """N-grams that both hold, in this one's symbols, and both weights: the two are walked together."""
        depth = len(self.levels)
        tables = [other.groups] + [other.words] * (depth - 1)
        maps = [_places(self.groups, other.numbers[0]), _places(self.words, other.numbers[1])]
        found: list[list[np.ndarray]] = [[] for _ in range(depth)]
        mine, theirs = [], []
        path: list[np.ndarray] = []
        one = np.zeros(min(1, len(self.levels[0][0]) - 1, len(other.levels[0][0]) - 1), np.int64)
        two = one
        for d in range(depth):
            start, label, weight, target = self.levels[d]
            _, _, weight_two, target_two = other.levels[d]
            size = len(tables[d]) + 1
            widths = start[one + 1] - start[one]
            back = np.repeat(np.arange(len(one)), widths)
            arcs = np.repeat(start[one] - np.cumsum(widths) + widths, widths) + np.arange(len(back))
            wanted = maps[min(d, 1)][label[arcs]]
            keys = other.arcs[d]
            asked = two[back] * size + wanted
            at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            met = (keys[at] == asked) & (wanted > 0) if len(keys) else np.zeros(len(asked), bool)
            back, arcs, at = back[met], arcs[met], at[met]
            path = [p[back] for p in path] + [label[arcs]]
            held = (weight[arcs] > 0) & (weight_two[at] > 0)
            for k in range(depth):
                found[k].append(path[k][held] if k <= d else np.zeros(int(held.sum()), np.int64))
            mine.append(weight[arcs][held])
            theirs.append(weight_two[at][held])
            on = (target[arcs] >= 0) & (target_two[at] >= 0)
            path, one, two = [p[on] for p in path], target[arcs][on], target_two[at][on]
        return [np.concatenate(f) for f in found], np.concatenate(mine), np.concatenate(theirs)

    def to_bytes(self) -> bytes:
        parts = [_symbols(self.groups), _symbols(self.words)]
        for level in self.levels:
            for n, array in enumerate(level):
                written = np.diff(array, prepend=0) if n == 0 else array
                parts.append(_narrow(written))
        head = np.array([len(p) for p in parts], "<u4").tobytes()
        return len(parts).to_bytes(1, "little") + squeezed(head + b"".join(parts))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        count, body = data[0], expanded(data[1:])
        ends = 4 * count + np.cumsum(np.frombuffer(body, "<u4", count).astype(np.int64))
        parts = [body[a:b] for a, b in zip([4 * count, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        arrays = [_wide(p) for p in parts[2:]]
        levels = [(np.cumsum(arrays[n]), *arrays[n + 1 : n + 4]) for n in range(0, len(arrays), 4)]
        return cls(_from_symbols(parts[0]), _from_symbols(parts[1]), levels)


def _places(asked: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """For each number of a symbol in `asked` the number it has in `number`, 0 where it has none."""
    return np.array([0, *[number.get(symbol, 0) for symbol in asked]], np.int64)


def _symbols(symbols: list[bytes]) -> bytes:
    return len(symbols).to_bytes(4, "little") + np.fromiter(map(len, symbols), "<u4", len(symbols)).tobytes() + b"".join(symbols)


def _from_symbols(data: bytes) -> list[bytes]:
    count = int(np.frombuffer(data, "<u4", 1)[0])
    lengths = np.frombuffer(data, "<u4", count + 1).astype(np.int64)
    lengths[0] = 4 * (count + 1)
    return [data[a:b] for a, b in pairwise(np.cumsum(lengths).tolist())]


def _narrow(array: np.ndarray) -> bytes:
    """The array, one more than each number, in as few bytes a number as its largest needs."""
    size = next(s for s in (1, 2, 4, 8) if int(array.max(initial=0)) + 1 < 1 << 8 * s)
    return bytes([size]) + (array + 1).astype(f"<u{size}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    size = data[0]
    return np.frombuffer(data, f"<u{size}", (len(data) - 1) // size, 1).astype(np.int64) - 1


def union(parts: Sequence[Transducer]) -> tuple[list[bytes], list[bytes], list[np.ndarray], np.ndarray]:
    """Symbols, sorted n-grams and summed weights of all parts, as `Transducer.build` takes them."""
    groups = sorted(set().union(*[p.groups for p in parts]))
    words = sorted(set().union(*[p.words for p in parts]))
    number_group = {s: n for n, s in enumerate(groups, 1)}
    number_word = {s: n for n, s in enumerate(words, 1)}
    columns: list[list[np.ndarray]] = [[] for _ in parts[0].levels]
    weights = []
    for part in parts:
        of_group = np.array([0, *map(number_group.__getitem__, part.groups)], np.int64)
        of_word = np.array([0, *map(number_word.__getitem__, part.words)], np.int64)
        found, weight = part.entries()
        for n, column in enumerate(found):
            columns[n].append((of_word if n else of_group)[column].astype(np.uint32))
        weights.append(weight)
    summed, total = combined([np.concatenate(c) for c in columns], np.concatenate(weights))
    return groups, words, summed, total


def _used(columns: Sequence[np.ndarray]) -> np.ndarray:
    """The numbers above zero in some columns, sorted."""
    held = np.sort(np.concatenate(columns))
    return held[np.concatenate([held[:1] > 0, held[1:] != held[:-1]])]


def restricted(groups: list[bytes], words: list[bytes], columns: Sequence[np.ndarray], weights: np.ndarray) -> Transducer:
    """The transducer of these sorted n-grams, with only the symbols they use."""
    used_groups = _used(columns[:1])
    used_words = _used(columns[1:])
    # Only numbers that are used are looked up.
    of_group, of_word = np.empty(len(groups) + 1, np.int64), np.empty(len(words) + 1, np.int64)
    of_group[0] = of_word[0] = 0
    of_group[used_groups] = np.arange(1, len(used_groups) + 1)
    of_word[used_words] = np.arange(1, len(used_words) + 1)
    return Transducer.build(
        [groups[n - 1] for n in used_groups.tolist()],
        [words[n - 1] for n in used_words.tolist()],
        [of_group[columns[0]], *[of_word[c] for c in columns[1:]]],
        weights,
    )


def boundary(groups: list[bytes], words: list[bytes], columns: Sequence[np.ndarray], limit: tuple[bytes, ...]) -> int:
    """How many of the sorted n-grams come before `limit`, a group and words."""
    low, high = 0, len(columns[0])
    for n, symbol in enumerate(limit):
        table = words if n else groups
        place = bisect_left(table, symbol)
        # Of the column's type, or the search would copy the column to another one.
        number = columns[n].dtype.type(place + 1)
        left = low + int(np.searchsorted(columns[n][low:high], number, side="left"))
        if place >= len(table) or table[place] != symbol:
            return left
        low, high = left, low + int(np.searchsorted(columns[n][low:high], number, side="right"))
    return low

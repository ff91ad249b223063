"""A wavelet matrix over token ids: one succinct file per shard with access, count, rank and select.

The distinct ids of a shard are numbered in order, so a file has as many bit-planes as the number of
its symbols needs. Each plane holds one bit of every symbol, in the order that the planes above it
have sorted the symbols into; beside it stand the number of zeros and the ones before each block. Planes are compressed one by
one and unpacked when they are first read; the rank directory is stored, so opening a file counts nothing.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_MAGIC = b"WVMX0003"
_HEAD = struct.Struct("<8sQII")
#: Bits between two entries of the rank directory.
BLOCK_BITS = 4096
_COMPRESSION = 1


class WaveletMatrix:
    """The matrix in memory. A plane is an array of bits, or its compressed bytes until `_plane` unpacks it."""

    def __init__(
        self,
        size: int,
        symbols: np.ndarray,
        planes: list[np.ndarray | bytes],
        zeros: list[int],
        before: list[np.ndarray] | None = None,
    ) -> None:
        self.size, self.symbols, self.planes, self.zeros = size, symbols, planes, zeros
        self._before = [_block_ranks(plane, size) for plane in planes] if before is None else before

    @classmethod
    def from_ids(cls, ids: np.ndarray) -> WaveletMatrix:
        if len(ids):
            numbers = np.zeros(int(ids.max()) + 1, np.uint32)
            numbers[ids] = 1
            symbols = np.flatnonzero(numbers).astype("<u4")
            numbers[symbols] = np.arange(len(symbols), dtype=np.uint32)
            row = numbers[ids]
            row = row.astype(np.uint16) if len(symbols) <= 1 << 16 else row
        else:
            row, symbols = np.zeros(0, np.uint16), np.zeros(0, "<u4")
        depth = max(1, (len(symbols) - 1).bit_length()) if len(symbols) else 0
        planes, zeros = [], []
        for level in range(depth - 1, -1, -1):
            bits = (row >> row.dtype.type(level) & row.dtype.type(1)).astype(bool)
            planes.append(np.packbits(bits))
            rest = np.compress(~bits, row)
            zeros.append(len(rest))
            row = np.concatenate([rest, np.compress(bits, row)])
        return cls(len(ids), symbols, planes, zeros)

    def to_bytes(self) -> bytes:
        packer = zstandard.ZstdCompressor(level=_COMPRESSION)
        packed = [packer.compress(self._plane(level)) for level in range(len(self.planes))]
        ranks = b"".join(np.ascontiguousarray(before, "<u4").tobytes() for before in self._before)
        lengths = np.array([len(plane) for plane in packed], "<u4").tobytes()
        head = _HEAD.pack(_MAGIC, self.size, len(self.symbols), len(self.planes))
        zeros = np.asarray(self.zeros, "<u8").tobytes()
        return b"".join([head, self.symbols.astype("<u4").tobytes(), zeros, ranks, lengths, *packed])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, size, count, depth = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = _HEAD.size

        def read(dtype: str, number: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(data, dtype, number, at)
            at += values.nbytes
            return values

        symbols, zeros = read("<u4", count), read("<u8", depth).tolist()
        before = [read("<u4", _blocks(size)) for _ in range(depth)]
        lengths = read("<u4", depth).tolist()
        planes = []
        for length in lengths:
            planes.append(data[at : at + length])
            at += length
        return cls(size, symbols, planes, zeros, before)

    def _plane(self, level: int) -> np.ndarray:
        plane = self.planes[level]
        if isinstance(plane, bytes):
            plane = self.planes[level] = np.frombuffer(zstandard.ZstdDecompressor().decompress(plane), np.uint8)
        return plane

    def ids(self) -> np.ndarray:
        """All ids in order, rebuilt from the last plane upwards."""
        dtype = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        row = np.zeros(self.size, dtype)
        for level, zeros in enumerate(reversed(self.zeros)):
            bits = np.unpackbits(self._plane(len(self.zeros) - 1 - level), count=self.size).view(bool)
            above = np.empty(self.size, dtype)
            above[np.flatnonzero(~bits)] = row[:zeros]
            above[np.flatnonzero(bits)] = row[zeros:] | dtype(1 << level)
            row = above
        return self.symbols[row] if len(self.symbols) else np.zeros(0, "<u4")

    def access(self, position: int) -> int:
        """The id at a position."""
        if not 0 <= position < self.size:
            raise IndexError(position)
        symbol = 0
        for level in range(len(self.planes)):
            ones = self._ones(level, position)
            bit = self._bit(level, position)
            symbol = symbol << 1 | bit
            position = self.zeros[level] + ones if bit else position - ones
        return int(self.symbols[symbol])

    def rank(self, token: int, end: int) -> int:
        """Occurrences of an id before a position."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        start, end = self._range(symbol, min(max(end, 0), self.size))
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, number: int) -> int:
        """Position of the occurrence with this number, from 0; -1 if there are not so many."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= number < self.count(token):
            return -1
        position = self._range(symbol, 0)[0] + number
        depth = len(self.planes)
        for level in range(depth - 1, -1, -1):
            bit = symbol >> (depth - 1 - level) & 1
            position = self._select_bit(level, bit, position - self.zeros[level] * bit)
        return position

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, number) for number in range(self.count(token))]

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.symbols, token))
        return at if at < len(self.symbols) and self.symbols[at] == token else None

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        start, depth = 0, len(self.planes)
        for level in range(depth):
            low, high = self._ones(level, start), self._ones(level, end)
            if symbol >> (depth - 1 - level) & 1:
                start, end = self.zeros[level] + low, self.zeros[level] + high
            else:
                start, end = start - low, end - high
        return start, end

    def _bit(self, level: int, position: int) -> int:
        return int(self._plane(level)[position >> 3]) >> (7 - (position & 7)) & 1

    def _ones(self, level: int, end: int) -> int:
        block, rest = divmod(end, BLOCK_BITS)
        tail = np.unpackbits(self._plane(level)[block * BLOCK_BITS // 8 : (end + 7) // 8], count=rest)
        return int(self._before[level][block]) + int(tail.sum())

    def _select_bit(self, level: int, bit: int, number: int) -> int:
        before = self._before[level].astype(np.int64)
        counts = before if bit else np.arange(len(before)) * BLOCK_BITS - before
        block = int(np.searchsorted(counts, number, side="right")) - 1
        start = block * BLOCK_BITS
        bits = np.unpackbits(self._plane(level)[start // 8 : start // 8 + BLOCK_BITS // 8])[: self.size - start]
        return start + int(np.flatnonzero(bits == bit)[number - int(counts[block])])


def _blocks(size: int) -> int:
    return size // BLOCK_BITS + 1


def _block_ranks(plane: np.ndarray, size: int) -> np.ndarray:
    per_block = BLOCK_BITS // 8
    ones = np.bitwise_count(plane)
    starts = np.arange(0, max(len(plane), 1), per_block)
    sums = np.add.reduceat(ones, starts, dtype=np.int64) if len(ones) else np.zeros(1, np.int64)
    ranks = np.concatenate([[0], np.cumsum(sums)])
    return ranks[: _blocks(size)].astype("<u4")

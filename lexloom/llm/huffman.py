"""Canonical length-limited Huffman coding of token ids, with table-driven decoding in independent blocks.

Code lengths come from global counts by the package-merge algorithm (Larmore and Hirschberg 1990), so they are optimal
under the limit; a canonical code follows from the lengths alone. Ids are packed most significant bit first. Every
BLOCK ids the encoder notes the bit offset: each checkpoint starts a block that decodes by itself, and the decoder steps
all blocks of a payload at once with one table lookup of `limit` bits an id.
"""

from __future__ import annotations

import numpy as np

#: Longest code in bits: the decoder's table has 2 ** LIMIT entries of 8 bytes.
LIMIT = 18
#: Ids a block: one checkpoint of 8 bytes each.
BLOCK = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length in bits of each symbol's code, 0 for symbols that never occur; package-merge, optimal under limit.

    >>> code_lengths(np.array([8, 4, 2, 1, 1]), 3).tolist()
    [1, 3, 3, 3, 3]
    """
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) <= 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols have no code of at most {limit} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weight, n = counts[order].astype(np.float64), len(order)
    # Each level merges the leaves with the packages (pairs) of the level below; a level keeps which of its items are leaves.
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[0 : len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[0] += 1
        depth[leaves] -= 1
        take = 2 * (take - leaves)
    lengths[order] = np.cumsum(depth)[:n]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), counted upward: the lengths alone fix them."""
    codes = np.zeros(len(lengths), np.uint64)
    symbols = np.flatnonzero(lengths)
    order = symbols[np.lexsort((symbols, lengths[symbols]))]
    widths = lengths[order].astype(np.int64)
    if len(order):
        # left-aligned in 64 bits, each code starts where the one before it ends
        ends = np.cumsum(np.uint64(1) << (np.uint64(63) - widths.astype(np.uint64)))
        starts = np.concatenate([np.zeros(1, np.uint64), ends[:-1]])
        codes[order] = starts >> (np.uint64(63) - widths.astype(np.uint64))
    return codes


class Codebook:
    """The canonical code of given lengths, ready to encode and decode."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths, self.limit = lengths.astype(np.int64), limit
        self.codes = canonical_codes(lengths)
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """For every `limit` bits: id << 6 | length of the code they begin with."""
        if self._table is None:
            table = np.zeros(1 << self.limit, np.int64)
            symbols = np.flatnonzero(self.lengths)
            order = symbols[np.lexsort((symbols, self.lengths[symbols]))]
            entries = np.repeat(order << 6 | self.lengths[order], 1 << (self.limit - self.lengths[order]))
            table[: len(entries)] = entries
            self._table = table
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints (little-endian uint64 bit offsets of every BLOCK-th id)."""
        widths = self.lengths[ids]
        if len(ids) and not widths.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(widths)
        starts = ends - widths
        total = int(ends[-1]) if len(ids) else 0
        # Codes overlap no bit, so sums of their parts in 32-bit words are their unions; doubles hold such sums exactly.
        shift = (64 - (starts & 31) - widths).astype(np.uint64)
        placed = self.codes[ids] << shift
        word, n = starts >> 5, (total >> 5) + 3
        high = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        payload = (high + low).astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8]
        return payload, starts[::BLOCK].astype("<u8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The n ids of a payload; all blocks advance together, one id a step."""
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        if not len(at):
            return np.empty(0, np.int64)
        # 32-bit big-endian windows at every byte: 7 bits of misalignment and a code fit
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.zeros((min(BLOCK, n), len(at)), np.int64)
        table, right, mask, last = self.table, 32 - self.limit, (1 << self.limit) - 1, len(payload)
        for k in range(len(out)):
            bits = window[np.minimum(at >> 3, last)]
            entry = table[(bits >> (right - (at & 7)).astype(np.uint32)) & mask]
            out[k] = entry >> 6
            at += entry & 63
        return out.T.reshape(-1)[:n]

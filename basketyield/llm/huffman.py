"""Canonical, length-limited Huffman codes on numpy arrays.

Codes are written most significant bit first.  Any symbol whose bit offset is
known can be decoded by itself, so a block is decoded from all its checkpoints
side by side, one table look-up per symbol.
"""

from __future__ import annotations

import numpy as np

#: Symbols between two checkpoints.
STRIDE = 256


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits (package-merge); 0 for symbols that do not occur.

    A single symbol gets one bit.
    """
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order]
    weights, is_leaf = leaves, np.ones(n, dtype=bool)
    levels = [is_leaf]
    for _ in range(max_bits - 1):
        pairs = len(weights) // 2
        packages = weights[: 2 * pairs].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        place = np.argsort(merged, kind="stable")
        weights, is_leaf = merged[place], place < n
        levels.append(is_leaf)
    # the cheapest 2n - 2 of the last level, then the parts of its packages, level by level
    take, times = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        times[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[order] = times
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size.max())
        # in units of the longest code, each code starts where the one before ends
        width = np.left_shift(np.int64(1), top - size)
        start = np.concatenate([[0], np.cumsum(width)[:-1]])
        codes[order] = (start >> (top - size)).astype(np.uint64)
    return codes


class Codec:
    """Encoder and decoder of one table of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.uint8)
        self.bits = max(1, int(self.lengths.max(initial=0)))
        if self.bits > 24:
            raise ValueError("codes of more than 24 bits do not fit a look-up")
        self.codes = canonical_codes(self.lengths)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[order].astype(np.int64)
        fill = np.left_shift(np.int64(1), self.bits - size)
        self.symbol_at = np.zeros(1 << self.bits, dtype=np.uint32)
        self.length_at = np.ones(1 << self.bits, dtype=np.int64)
        self.symbol_at[: fill.sum()] = np.repeat(order, fill)
        self.length_at[: fill.sum()] = np.repeat(size, fill)

    def encode(self, symbols: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The packed bits and the bit offset of every ``STRIDE``-th symbol."""
        if not len(symbols):
            return b"", np.zeros(0, dtype=np.int64)
        size = self.lengths[symbols].astype(np.int64)
        end = np.cumsum(size)
        begin = end - size
        code = self.codes[symbols]
        word, last = begin >> 6, (end - 1) >> 6
        # bits right of the code in the word that it begins in; negative if it runs on into the next
        right = 64 - (begin & 63) - size
        here = np.where(right >= 0, code << np.maximum(right, 0).astype(np.uint64), code >> np.maximum(-right, 0).astype(np.uint64))
        words = np.zeros(int(last[-1]) + 1, dtype=np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        # codes are shorter than a word, so that one begins in each word but perhaps the last
        words[word[first]] = np.bitwise_or.reduceat(here, first)
        over = np.flatnonzero(right < 0)
        words[last[over]] |= code[over] << (64 + right[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], begin[::STRIDE]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` symbols of a block, from all its checkpoints at once."""
        if n == 0:
            return np.zeros(0, dtype=np.uint32)
        pad = STRIDE * self.bits // 8 + 8
        data = np.frombuffer(payload + bytes(pad), dtype=np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = np.array(checkpoints, dtype=np.int64)
        out = np.empty((STRIDE, len(at)), dtype=np.uint32)
        mask, room = np.uint32((1 << self.bits) - 1), 32 - self.bits
        for step in range(min(STRIDE, n)):
            key = (window[at >> 3] >> (room - (at & 7)).astype(np.uint32)) & mask
            out[step] = self.symbol_at[key]
            at += self.length_at[key]
            np.minimum(at, (len(window) - 1) << 3, out=at)
        return out.T.reshape(-1)[:n]

"""Byte-level BPE, encoding and decoding, without a regular expression.

Pre-tokens come from arrays.  Every code point has a class (letter, number,
blank, other white space, apostrophe, other).  A class is a transition
function on the few states of a scanner, and functions compose associatively:
a scan that doubles its reach composes each position's function with those
before it until none depends on the state it starts from.  As the functions
form a small monoid, composing two is one look-up in its table.  The states
give the boundaries; texts of a batch are scanned in one array, with a
function that forgets the past at each start.

Slices between boundaries are merged pair by pair, lowest rank first, and
held, so that a slice seen before costs one look-up.  Decoding copies the
bytes of all ids of a batch at once, by their offsets.

Null texts count as empty: no ids, empty bytes.  Rows are independent, so
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import heapq
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, in_parts

PIECE_CACHE = 400_000
LONGEST_HELD = 64
#: Characters scanned in one array, about.
BATCH_CHARS = 1 << 20

# --- classes, states and the transition monoid --------------------------------

LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER = range(6)
#: A state is the class of the last character; of an apostrophe only if it begins a token, else OTHER.  START: no character yet.
START = 6
_WHITE = frozenset([*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_KIND = np.array([0, 1, 2, 2, 3, 3, 4], dtype=np.uint8)  # what may stand in one token


def _step(state: int, cls: int) -> int:
    if cls == APOSTROPHE and state in (OTHER, APOSTROPHE, BLANK):
        return OTHER  # inside a run, or taken by the blank before it
    return cls


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class, element of each class at a start, composition table, and the constant value of an element or 255."""
    by_class = [tuple(_step(s, c) for s in range(7)) for c in range(6)]
    at_start = [(_step(START, c),) * 7 for c in range(6)]
    elements = list(dict.fromkeys(by_class + at_start))
    for f in elements:  # grows while it is walked
        for g in by_class + at_start:
            for h in (tuple(g[f[s]] for s in range(7)), tuple(f[g[s]] for s in range(7))):
                if h not in elements:
                    elements.append(h)
    number = {f: i for i, f in enumerate(elements)}
    compose = np.array([[number[tuple(g[f[s]] for s in range(7))] for g in elements] for f in elements], dtype=np.uint8)
    value = np.array([f[0] if len(set(f)) == 1 else 255 for f in elements], dtype=np.uint8)
    pick = lambda fs: np.array([number[f] for f in fs], dtype=np.uint8)
    return pick(by_class), pick(at_start), compose, value


_BY_CLASS, _AT_START, _COMPOSE, _VALUE = _monoid()


def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            table[code] = LETTER
        elif major == "N":
            table[code] = NUMBER
    table[list(_WHITE)] = SPACE
    table[0x20], table[0x27] = BLANK, APOSTROPHE
    return table


def scan_states(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """State after every character, by a scan over composed transition functions."""
    held = _BY_CLASS[classes]
    held[starts] = _AT_START[classes[starts]]
    reach = 1
    while reach < len(held) and (_VALUE[held[1:]] == 255).any():
        held[reach:] = _COMPOSE[held[:-reach], held[reach:]]
        reach *= 2
    return _VALUE[held]


def boundaries(codes: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a token begins at each character of concatenated texts that begin at ``starts``."""
    n = len(codes)
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    first[n] = True
    state = scan_states(classes, starts)
    before = np.empty_like(state)
    before[1:] = state[:-1]
    before[starts] = START
    white = (state == BLANK) | (state == SPACE)
    white_before = (before == BLANK) | (before == SPACE)
    # the last blank of a run goes with what follows it, any other last white space stands alone
    words_follow = np.empty(n, dtype=bool)
    words_follow[:-1] = ~white[1:]
    words_follow[-1:] = False
    words_follow &= ~first[1:]
    begin = np.where(white, ~white_before | words_follow, (_KIND[state] != _KIND[before]) & (before != BLANK))
    # an apostrophe that begins a token takes s, t, m, d, re, ve or ll with it
    at = np.flatnonzero(state[:-1] == APOSTROPHE)
    at = at[~first[at + 1]]
    if len(at):
        one = codes[at + 1]
        two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n)], codes[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begin[at[short | long] + 1] = False
        end = np.concatenate([at[short] + 2, at[long] + 3])
        begin[end[end < n]] = True
    begin[starts] = True
    return begin


# --- merging --------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Merged(dict):
    """Slice -> packed ids."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.merge(piece)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_HELD:
            if len(self) >= PIECE_CACHE:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LONGEST_HELD:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 60:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list."""
        n, ranks = len(piece), self.ranks
        end, after, prior = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                prior[after[i]] = i
            for a in (prior[i], i):
                if a >= 0 and after[a] < n and (r := ranks.get(piece[a : end[after[a]]])) is not None:
                    heapq.heappush(heap, (r, a, end[after[a]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out


class ByteBpe:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.merged = _Merged(ranks)
        self.classes = class_table()
        tokens = sorted(ranks, key=ranks.__getitem__)
        numbers = np.array([ranks[t] for t in tokens])
        self.size = np.zeros(int(numbers.max(initial=-1)) + 1, dtype=np.int64)
        self.size[numbers] = [len(t) for t in tokens]
        self.place = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.store = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        gc.freeze()

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """Packed ids of each text, and the byte offsets of its slices."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        joined = "".join(texts)
        data = joined.encode()
        if not data:
            return [(b"", np.zeros(0, dtype=np.int64)) for _ in texts]
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        starts = (ends - sizes)[sizes > 0]
        begin = np.flatnonzero(boundaries(codes, self.classes[codes], starts))
        if len(data) == len(codes):
            at = begin
        else:
            width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            at = (np.cumsum(width) - width)[begin]
        at = np.append(at, len(data))
        edge = np.searchsorted(begin, np.concatenate([[0], ends]))
        cuts = at.tolist()
        get, out = self.merged.__getitem__, []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            ids = b"".join([get(data[a:b]) for a, b in zip(cuts[i:j], cuts[i + 1 : j + 1], strict=True)])
            out.append((ids, at[i:j] - at[i]))
        return out

    def decode_batch(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each text, copied for all ids at once."""
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        offsets = ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total, dtype=np.int64) + np.repeat(self.place[ids] - offsets, sizes)
        data = self.store[source].tobytes()
        last = np.cumsum([len(p) // 4 for p in packed])
        edge = np.concatenate([[0], ends])[np.concatenate([[0], last])].tolist()
        return [data[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]


_HELD: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder for a file, loaded once."""
    if path not in _HELD:
        _HELD[path] = ByteBpe(path)
    return _HELD[path]


# --- on DataFrames -----------------------------------------------------------------

_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("slices", pa.binary())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def encode_documents(docs: DataFrame, path: str, offsets: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit) and ``slices``, the byte offsets (32-bit) of the pre-tokens."""

    def run(parts):
        bpe = byte_bpe(path)

        def rows():
            for part in parts:
                names = part.column(0).to_pylist()
                for start, texts in in_parts([t or "" for t in part.column(1).to_pylist()], most=BATCH_CHARS):
                    for i, (ids, at) in enumerate(bpe.encode_batch(texts), start):
                        yield names[i], ids, at.astype("<u4").tobytes() if offsets else None

        yield from batches(_ENCODED, rows())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids binary, slices binary"
    )


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes of packed ids; null ids count as none."""

    def run(parts):
        bpe = byte_bpe(path)

        def rows():
            for part in parts:
                names = part.column(0).to_pylist()
                packed = [p or b"" for p in part.column(1).to_pylist()]
                for start, held in in_parts(packed, most=BATCH_CHARS):
                    for i, decoded in enumerate(bpe.decode_batch(held), start):
                        yield names[i], packed[i], decoded

        yield from batches(_DECODED, rows())

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again."""
    decoded = decode_documents(encode_documents(docs, path, offsets=False), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

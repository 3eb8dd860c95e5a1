"""Token files, packing and byte-level BPE against the libraries and brute force."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketyield.llm import byte_bpe, huffman, packing, token_file
from basketyield.llm.word_ids import default_path, word_encoder
from basketyield.stage import Stage

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return t


def own_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ALPHABET = "ab'sstremvdllNO  \n\t\r\x0b\x1c\x1f\x85\xa0　 12½³٣!?.,-_#éßΣςİ你好🙂'́<|>"


def samples(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_word_encoder_is_the_library(tokenizer):
    encoder = word_encoder(default_path())
    for text in [*samples(1500, 1), "<|endoftext|> a", "x" * 3000, "1" * 500]:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == own_ids(tokenizer, text), repr(text)


def test_added_tokens_as_the_library_finds_them():
    library = Tokenizer.from_file(default_path())
    encoder = word_encoder(default_path(), added_tokens=True)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y  <|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|endoftext|>\u0338 É\x1c", *samples(300, 8)]
    assert own_ids(library, texts[0]) == [320, 49407, 321]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == own_ids(library, text), repr(text)


def test_token_file_holds_added_tokens(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    path = str(tmp_path / "added")
    token_file.write_token_file(frame, path, default_path(), end_id=1)
    got = token_file.read_token_file(spark, path).collect()[0]
    assert np.frombuffer(got.ids, "<u4").tolist()[:3] == [320, 49407, 321]


# --- Huffman codes ------------------------------------------------------------------


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(6, 10))
@settings(deadline=None, max_examples=60)
def test_code_round_trip(counts, bits):
    lengths = huffman.code_lengths(np.array(counts), bits)
    assert (lengths > 0).tolist() == [c > 0 for c in counts] and lengths.max() <= bits
    assert sum(2.0 ** -int(n) for n in lengths if n) <= 1
    symbols = np.repeat(np.arange(len(counts)), counts)
    np.random.default_rng(0).shuffle(symbols)
    codec = huffman.Codec(lengths)
    payload, checkpoints = codec.encode(symbols)
    assert len(checkpoints) == -(-len(symbols) // huffman.STRIDE)
    assert (codec.decode(payload, checkpoints, len(symbols)) == symbols).all()


def test_lengths_are_optimal():
    """Against every assignment of lengths that satisfies Kraft's inequality."""
    rng = random.Random(3)
    for _ in range(30):
        counts, bits = [rng.randint(1, 60) for _ in range(5)], rng.choice([3, 4])
        got = huffman.code_lengths(np.array(counts), bits)
        best = min(
            sum(c * n for c, n in zip(counts, sizes))
            for sizes in itertools.product(range(1, bits + 1), repeat=5)
            if sum(2.0**-n for n in sizes) <= 1
        )
        assert sum(c * int(n) for c, n in zip(counts, got)) == best


def test_too_many_symbols_for_the_limit():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


# --- token files --------------------------------------------------------------------


def expected_file(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own_ids(tokenizer, text), 1]
        out.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_token_file(spark, docs, tokenizer):
    path = Stage(spark).path("file")
    token_file.write_token_file(docs, path, default_path(), end_id=1)
    expected = expected_file(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])
    got = token_file.read_token_file(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == expected
    digest = token_file.read_token_file(spark, path, digest=True).orderBy("start").collect()
    assert [(r.start, r.ids_crc32) for r in digest] == [(s, zlib.crc32(i)) for _, s, _, i in expected]


def test_long_documents_are_blocks_of_their_own(spark, docs, tokenizer, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 8)
    lengths = huffman.code_lengths(np.ones(50000, dtype=np.int64), 20)
    write = token_file._block_writer(lengths, "<u2")
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):
            return 4

    monkeypatch.setattr(token_file, "TaskContext", Context)
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (3, 4, 20, 1, 8)]
    part = pa.record_batch([pa.array(range(5), pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    blocks = [r for b in write([part]) for r in b.to_pylist()]
    assert [b["doc_tokens"] for b in blocks] == [[3, 4], [20], [1], [8]]
    assert [b["first_token"] for b in blocks] == [0, 7, 27, 28] and {b["shard"] for b in blocks} == {4}


def test_token_file_without_rows_and_without_ids(spark, no_docs, null_ids):
    path = Stage(spark).path("none")
    token_file.write_token_file(no_docs, path, default_path())
    assert token_file.read_token_file(spark, path).count() == 0
    path = Stage(spark).path("null")
    token_file.write_token_file(null_ids, path, default_path())
    assert sorted(r.start for r in token_file.read_token_file(spark, path).collect())[0] == 0


# --- packing --------------------------------------------------------------------------


def fewest(sizes, capacity):
    """The optimum, by trying every dealing of the pieces."""
    best = len(sizes)

    def deal(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                deal(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        deal(i + 1, [*rooms, capacity - sizes[i]])

    deal(0, [])
    return best


def check_packing(sizes, capacity, fillings):
    held = np.zeros(capacity + 1, dtype=int)
    for filling, n in fillings:
        assert sum(s * k for s, k in filling) <= capacity and n > 0
        for s, k in filling:
            held[s] += k * n
    assert held.tolist() == np.bincount(sizes, minlength=capacity + 1).tolist()


def test_packing_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 20, 60])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fillings = packing.pack_histogram(np.bincount(sizes, minlength=capacity + 1), capacity)
        check_packing(sizes, capacity, fillings)
        assert sum(n for _, n in fillings) == fewest(sizes, capacity), (capacity, sizes)
        assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= fewest(sizes, capacity)


def test_bin_completion_beats_best_fit():
    sizes = [6, 5, 5, 4, 3, 3, 2, 2]  # 30 = 3 x 10
    counts = np.bincount(sizes, minlength=11)
    assert sum(n for _, n in packing.pack_histogram(counts, 10)) == 3
    many = counts * 1000
    fillings = packing.pack_histogram(many, 10)
    assert sum(n for _, n in fillings) == 3000


def test_packing_of_many_short_pieces():
    for sizes in ({3: 4096}, {3: 100_000}, {2: 4096}, {1500: 999}, {1: 5, 3: 4096}, {s: 1 for s in range(1, 4097)}):
        counts = np.zeros(4097, dtype=int)
        counts[list(sizes)] = list(sizes.values())
        fillings = packing.pack_histogram(counts)
        check_packing(np.repeat(np.arange(4097), counts), 4096, fillings)
        # as few as there can be: as many to a sequence as fit, or all but full
        least = -(-sizes[3] // 1365) if list(sizes) == [3] else 500 if list(sizes) == [1500] else packing.lower_bound(counts, 4096)
        assert sum(n for _, n in fillings) == least


def test_search_to_the_end_is_optimal():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        sizes = sorted((rng.randint(max(1, capacity // 6), capacity // 2) for _ in range(rng.randint(4, 10))), reverse=True)
        fillings = packing.pack_histogram(np.bincount(sizes, minlength=capacity + 1), capacity, None)
        check_packing(sizes, capacity, fillings)
        assert sum(n for _, n in fillings) == fewest(sizes, capacity)


def test_fillings_come_fullest_first_and_miss_no_better_one():
    counts = np.bincount([7, 5, 4, 4, 3, 3, 2], minlength=16)
    found = list(packing.fillings(counts, 7, 15))
    rooms = [15 - sum(s * n for s, n in f) for f in found]
    assert rooms == sorted(rooms) and rooms[0] == 0
    assert ((7, 1), (5, 1), (3, 1)) in found and ((7, 1), (4, 2)) in found
    assert not any(dict(f).get(2) and dict(f).get(3) and not dict(f).get(5) for f in found)  # 5 takes the place of 2 and 3


def test_packing_places_every_piece(docs, tokenizer):
    rows = packing.pack_documents(docs, default_path(), end_id=1, capacity=64).collect()
    expected = []
    for r in docs.collect():
        ids = [*own_ids(tokenizer, r.text), 1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            own = ids[start : start + 64]
            expected.append((r.doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for _, group in itertools.groupby(places, key=lambda p: p[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length
        assert at <= 64


def test_packing_edge_tables(no_docs, null_ids):
    assert packing.pack_documents(no_docs, default_path()).count() == 0
    assert packing.pack_documents(null_ids, default_path()).count() == 4


# --- byte-level BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_is_the_library(reference):
    bpe = byte_bpe.byte_bpe(RANKS)
    for k in range(60):
        texts = [*samples(40, k), "don't we'll I'd 've ''s", " 's", "\n's", "a  b \n c  "]
        encoded = bpe.encode_batch(texts)
        assert [np.frombuffer(i, "<u4").tolist() for i, _ in encoded] == [reference.encode_ordinary(t) for t in texts]
        assert bpe.decode_batch([i for i, _ in encoded]) == [t.encode() for t in texts]


def test_long_slices(reference):
    bpe = byte_bpe.byte_bpe(RANKS)
    for text in ("x" * 4000, " " * 3000, "ab" * 2000, "é" * 500, "=-" * 900):
        assert np.frombuffer(bpe.encode_batch([text])[0][0], "<u4").tolist() == reference.encode_ordinary(text)


def test_slice_offsets_cut_the_text():
    text = "Hé's  there\n 12"
    ((_, at),) = byte_bpe.byte_bpe(RANKS).encode_batch([text])
    data = text.encode()
    cuts = [*at.tolist(), len(data)]
    assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:])] == ["Hé", "'s", " ", " there", "\n", " 12"]


def test_scan_is_the_automaton():
    rng = np.random.default_rng(2)
    classes = rng.integers(0, 6, 4000).astype(np.uint8)
    starts = np.array([0, 10, 11, 700])
    state, expected = byte_bpe.START, []
    for i, c in enumerate(classes):
        state = byte_bpe._step(byte_bpe.START if i in starts else state, int(c))
        expected.append(state)
    assert byte_bpe.scan_states(classes, starts).tolist() == expected


def test_byte_bpe_rows(docs, no_docs, null_ids, reference):
    import hashlib

    rows = byte_bpe.digests(docs, RANKS).collect()
    expected = []
    for r in docs.collect():
        text = r.text or ""
        ids = np.array(reference.encode_ordinary(text), "<u4")
        expected.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in rows) == sorted(expected)
    assert byte_bpe.digests(no_docs, RANKS).count() == 0 and byte_bpe.digests(null_ids, RANKS).count() == 4

"""Token ids of whole texts by a word-level BPE file, one cached word at a time.

The files that this serves drop white space, so the ids of a text are those of
its words in a row.  A word seen before costs one look-up; the pieces of a new
one go to the model of the ``tokenizers`` library.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import unicodedata

import numpy as np
import regex

#: White space of str.split() that the tokenizer takes for ordinary characters.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = regex.compile(f"[{_WHITE}]+")
#: Words and pieces held per worker; a full cache is emptied.
WORD_CACHE = 200_000
PIECE_CACHE = 600_000
#: Longer ones are not held.
LONGEST_HELD = 64


def _byte_characters() -> dict[int, int]:
    """The printable stand-in of each byte: itself where it is visible, else the next code from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Pre-token -> packed ids."""

    def __init__(self, model, code: str):
        super().__init__()
        self.tokenize, self.code, self.stand_in = model.tokenize, code, _byte_characters()

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.stand_in)
        ids = [t.id for t in self.tokenize(shown)]
        packed = struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(piece) <= LONGEST_HELD:
            if len(self) >= PIECE_CACHE:
                self.clear()
            self[piece] = packed
        return packed


class _Words(dict):
    """Word between white space -> packed ids."""

    def __init__(self, pieces: _Pieces, pattern):
        super().__init__()
        self.pieces, self.split = pieces, pattern.findall

    def __missing__(self, word: str) -> bytes:
        text = word if word.isascii() else unicodedata.normalize("NFC", word)
        # one character at a time: no final sigma
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        pieces = self.pieces
        if text.isalpha():
            packed = pieces[text]
        elif text[:-1].isalpha():
            packed = pieces[text[:-1]] + pieces[text[-1]]
        else:
            packed = b"".join([pieces[p] for p in self.split(text)])
        if len(word) <= LONGEST_HELD:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = packed
        return packed


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian ``dtype`` bytes; a null text counts as empty.

    For files with the normaliser NFC, white space to one blank, lower case,
    and a split on letters, digits and other characters.  With ``added_tokens``
    the tokens that the file adds are found in a text as the library finds
    them by default; otherwise they are ordinary characters.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.n_ids <= 1 << 16 else "<u4"
        pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
        self.words = _Words(_Pieces(self.tokenizer.model, "H" if self.dtype == "<u2" else "I"), pattern)
        added = self.tokenizer.get_added_tokens_decoder().values() if added_tokens else ()
        self.raw = [t.content for t in added if not t.normalized]
        self.normalized = [t.content.lower() for t in added if t.normalized]
        gc.freeze()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.raw) or self.normalized and any(t in text.lower() for t in self.normalized):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        words = text.split() if not _SEPARATORS.search(text) else [w for w in _SPACES.split(text) if w]
        return b"".join(map(self.words.__getitem__, words))


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def word_encoder(path: str, added_tokens: bool = False) -> WordEncoder:
    """The worker's encoder for a file, loaded once."""
    if (path, added_tokens) not in _ENCODERS:
        _ENCODERS[path, added_tokens] = WordEncoder(path, added_tokens)
    return _ENCODERS[path, added_tokens]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

"""Byte-level BPE ids of whole texts by the ``tokenizers`` library, memoised by space-delimited piece.

A byte-level pre-tokenizer never joins the two sides of a single space, unless white space stands on both
sides of it; so a text is cut before such spaces and each distinct piece is encoded once by the library.
Texts for which the cut isn't safe are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

#: White space of Unicode and the separators U+001C to U+001F (fixed values).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: Pieces made of these have pre-tokens that the simple pattern below finds exactly.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ſ0-9!-/:-@\[-`{-~\n]*\Z")
#: The byte-level splitting pattern over the characters of PLAIN, a leading space allowed (fixed value).
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")

_after_space = [" " + c for c in SPACES]


def byte_alphabet() -> str:
    """The printable stand-in of each byte 0..255 in byte-level vocabularies, as a translation string."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return "".join(chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256))


def cuttable(text: str) -> bool:
    """Whether every single space of ``text`` is a safe place to cut (judged on the safe side)."""
    return not any(pair in text for pair in _after_space)


class _Memo(dict):
    """Text -> packed ids.  Keys of more than ``LONGEST`` characters aren't kept.  A memo that has taken half of
    ``room`` bytes becomes the old one, and what isn't asked for again goes with it; so memory stays bounded whatever
    the texts are, and common pieces stay."""

    LONGEST, ENTRY = 64, 180  # an entry's own bytes: two objects and a slot of the table

    def __init__(self, find, room: int):
        self.find, self.old, self.room, self.left = find, {}, room // 2, room // 2

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.find(key)
        if len(key) <= self.LONGEST:
            self.left -= self.ENTRY + 2 * len(key)
            if self.left < 0:
                self.old = dict(self)
                self.clear()
                self.left = self.room
            self[key] = out
        return out


class Encoder:
    """``encode(text)`` gives the ids as packed little-endian integers of ``dtype``.

    ``room`` bounds the bytes that all memos together hold."""

    def __init__(self, path: str, room: int = 224 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        packed = [int(i).to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        model, stand_in = self.tokenizer.model, dict(enumerate(byte_alphabet()))

        def by_model(token: str) -> bytes:
            """A pre-token by the library's own model, which takes it in the byte alphabet."""
            return b"".join([packed[t.id] for t in model.tokenize(token.encode().decode("latin-1").translate(stand_in))])

        self.tokens = _Memo(by_model, room // 2)
        self.first = _Memo(self.piece, room // 16)
        self.later = _Memo(lambda piece: self.piece(" " + piece), room * 7 // 16)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, text: str) -> bytes:
        if not PLAIN.match(text, text[:1] == " "):
            return self.whole(text)
        parts = SPLIT.findall(text)
        return self.tokens[text] if len(parts) == 1 else b"".join([self.tokens[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not cuttable(text) or any(s in text for s in self.specials):
            return self.whole(text)
        head, *rest = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Token ids of whole texts through the tokenizers library, with a bounded cache of pieces.

A byte-pair tokenizer first cuts a text into pre-tokens, which never reach over a word's end, so
a text's ids are the ids of its pieces one after another. Natural text repeats its pieces; each
Python worker keeps the ids of those it has seen and asks the library only for the others.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np

from .common import WORKER_CACHES

CACHE_PIECES = 600_000   # pieces kept by a worker; later ones are encoded each time
CACHE_TAILED = 100_000   # pieces with marks behind the word kept as such; others are put together from the word and the marks
LONG_PIECE = 64          # longer pieces aren't kept
TAIL = ".,;:!?#$%&*"     # marks that both kinds of tokenizer cut off from the letters before them


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def special_strings(tokenizer) -> re.Pattern:
    """Strings of the tokenizer's special tokens. The library takes them for the tokens wherever they stand, so a text
    that holds one is never cut into pieces."""
    return re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers.

    A piece of letters is one pre-token, so the library's model is asked directly; ``to_model``
    gives its spelling there, or None if the whole tokenizer must see it. The marks behind a word are
    pre-tokens of their own, so such a piece is the word's ids and the marks': a word is asked for once, whatever follows it.
    """

    def __init__(self, tokenizer, lead: str, to_model):
        super().__init__()
        self.tokenizer, self.model, self.lead, self.to_model = tokenizer, tokenizer.model, lead, to_model
        self.led, self.tails, self.n_tailed = _byte_spelling(lead), {}, 0

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        core = piece.rstrip(TAIL)
        spelled = self.to_model(core) if core.isalpha() else None
        if spelled is None:
            ids = self.encode(piece if piece[:1] == "\n" else self.lead + piece)
        elif len(core) < len(piece):
            tail = piece[len(core):]
            if tail not in self.tails:
                if len(self.tails) >= 1000:
                    self.tails.clear()
                self.tails[tail] = self.encode(tail)
            ids = self[core] + self.tails[tail]
            if self.n_tailed >= CACHE_TAILED:
                return ids
            self.n_tailed += len(piece) <= LONG_PIECE
        else:
            found = [t.id for t in self.model.tokenize(self.led + spelled)]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONG_PIECE and len(self) < CACHE_PIECES:
            self[piece] = ids
        return ids


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = str.maketrans(_byte_characters())


def _byte_spelling(word: str) -> str:
    if word.isascii() and word.isalpha():
        return word
    return word.encode().decode("latin-1").translate(_BYTES)


def _lower_byte_spelling(word: str) -> str | None:
    # The final sigma is the one letter whose lower case depends on its neighbours.
    if "\u03a3" in word or not (word.isascii() or unicodedata.is_normalized("NFC", word)):
        return None
    lower = word.lower()
    return _byte_spelling(lower) if lower.isalpha() else None


class SpaceLed:
    """For tokenizers whose pre-tokens may begin with the space before a word.

    A text is cut before each white-space run. That is right only if the cut knows the whole run,
    so it is made at single spaces and newlines, at runs of those two by a pattern, and a text
    that holds any other white space is encoded in one go.
    """

    # White space beside space and newline; a search for each is faster than one pattern for all.
    OTHER = tuple("\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
    ASCII_OTHER = OTHER[:8]
    DOUBLE = ("  ", " \n", "\n ", "\n\n")
    RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")

    def __init__(self, path: str):
        t = load_tokenizer(path)
        self.special = special_strings(t)
        self.first, self.rest, self.runs = (_Pieces(t, lead, _byte_spelling) for lead in ("", " ", ""))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(c in text for c in (self.ASCII_OTHER if text.isascii() else self.OTHER)) or self.special.search(text):
            return self.first.encode(text)
        if any(c in text for c in self.DOUBLE):
            return b"".join(map(self.runs.__getitem__, self.RUNS.findall(text)))
        head, *tail = text.replace("\n", " \n").split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.rest.__getitem__, tail))


class SpaceFree:
    """For tokenizers that drop white space: any ASCII space or newline is a place to cut."""

    def __init__(self, path: str):
        t = load_tokenizer(path)
        self.special = special_strings(t)
        self.pieces = _Pieces(t, "", _lower_byte_spelling)
        self.pieces[""] = b""

    def __call__(self, text: str) -> bytes:
        if self.special.search(text):
            return self.pieces.encode(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(kind: type, path: str):
    """The encoder of this worker for a tokenizer file."""
    if (kind, path) not in WORKER_CACHES:
        WORKER_CACHES[kind, path] = kind(path)
    return WORKER_CACHES[kind, path]

"""Token ids of whole texts by a public tokenizer file, word by word.

The vocabulary's pre-tokenizer drops white space and never crosses it, so the ids of a text are those of its
words in a row. Ids are remembered per word and per pre-token; only new pre-tokens reach the tokenizer.
"""

from __future__ import annotations

import re
from array import array

import regex

#: Words, and pre-tokens, that a worker remembers (some 100 MB each); emptied beyond that.
CACHE_ENTRIES = 600_000

#: Words of these characters are already composed and lower-case alike in every library; all others, and
#: those that may hold a special token, go through the tokenizer whole.
_PLAIN = regex.compile(r"[\x21-\x7E¡-¬®-įĲ-ž]*")
#: The pre-tokenizer's own pattern (fixed value of the vocabulary file), and what it means for lower-case ASCII.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Marks that are a pre-token of their own behind letters.
_MARKS = frozenset(".,;:!?")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_names() -> dict[int, str]:
    """The characters a vocabulary's names use for bytes: visible ones stand for themselves, all others are
    numbered from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(rest)) for b in range(256)}


_known: dict[str, WordIds] = {}


def word_ids(path: str | None = None) -> WordIds:
    """This worker process' ids: loaded once, so that later tasks know the words of earlier ones."""
    path = path or default_vocabulary()
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


class WordIds(dict):
    """word (UTF-8 bytes without ASCII white space) -> its ids as little-endian 32-bit numbers."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path or default_vocabulary())
        self._model = self._whole.model
        self._names = byte_names()
        self._pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        # Letters, with a mark behind them or not, need no pattern to be cut.
        stem, mark = (text[:-1], text[-1]) if text[-1] in _MARKS else (text, "")
        if stem.isalpha() and (stem.isascii() or _PLAIN.fullmatch(stem)):
            piece = stem.lower()
            ids = self._pieces.get(piece) or self._piece(piece)
            if mark:
                ids += self._pieces.get(mark) or self._piece(mark)
        elif _PLAIN.fullmatch(text) and "<|" not in text:
            pieces = (_ASCII_PIECES if text.isascii() else _PIECES).findall(text.lower())
            ids = b"".join([self._pieces.get(p) or self._piece(p) for p in pieces])
        else:
            ids = packed(self._whole.encode(text, add_special_tokens=False).ids)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        # A visible ASCII character stands for its own byte.
        named = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._names)
        ids = array("I", [t.id for t in self._model.tokenize(named)]).tobytes()
        if len(self._pieces) >= CACHE_ENTRIES:
            self._pieces.clear()
        self._pieces[piece] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, as bytes."""
        return b"".join(map(self.__getitem__, text.split()))


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()

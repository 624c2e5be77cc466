"""Token ids of whole texts by a byte-level tokenizer file, chunk by chunk.

The vocabulary's pre-tokenizer never lets a token reach from a character that is no white space over the white
space after it. So a text may be cut there, and the ids of a text are those of its chunks in a row; equal words
are encoded once per worker. A word of common letters is cut into pre-tokens here, and only new pre-tokens reach
the tokenizer's model; all others go through the tokenizer whole.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode

import regex

from packwright.llm.word_tokens import byte_names, packed

#: Words that a worker remembers (some 90 MB), as many of the time before, and pre-tokens.
CACHE_ENTRIES = 500_000

# White space of any library, and what might be: a cut is made only after characters outside this class.
_ODD = r"\x00-\x20\x7F-\xA0\xAD\u1680\u180E\u2000-\u200F\u2028-\u202F\u205F-\u206F\u3000\uFEFF"
_IRREGULAR = re.compile(rf"(?:^|[{_ODD}])\x20")
_AT_SPACE = re.compile(rf"(?<=[^{_ODD}])(?=\x20)")
_AT_LINE = re.compile(rf"(?<=[^{_ODD}])(?=\n)")
#: Bytes that some odd character but space and line feed has: a text without them needs no closer look.
_RARE = bytes([*range(0x0A), *range(0x0B, 0x20), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])

#: Chunks of these characters are cut alike by every library; what may hold a special token is not.
_PLAIN = re.compile(r"[\x20\n]?[\x21-\x7E\xA1-\xAC\xAE-\u017E]*")
#: The pre-tokenizer's own pattern (fixed value of the vocabulary file), and what it means for ASCII chunks.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Marks that no pre-token joins to the letters before them.
_MARKS = frozenset(".,;:!?")
#: What may follow a line break, to be cut without a pattern: letters, and a mark or none.
_LINE = re.compile(r"[A-Za-z]+[.,;:!?]?")

_encoders: dict[str, ByteIds] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ids(path: str | None = None) -> ByteIds:
    """This worker process' encoder: loaded once, so that later tasks know the chunks of earlier ones."""
    path = path or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = ByteIds(path)
    return _encoders[path]


class ByteIds(dict):
    """Encodes texts; ids come as little-endian 32-bit numbers. As a dictionary: word -> its ids with a space before
    it, for as many words as the bound allows."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        names = byte_names()
        self._names, self._space = "".join(names[b] for b in range(256)), names[0x20]
        self._old: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        return list(map(self._text, texts))

    def _text(self, text: str) -> bytes:
        if _irregular(text):
            return b"".join(map(self._chunk, _chunks(text)))
        head, *words = text.split(" ")
        return b"".join([*map(self._chunk, _AT_LINE.split(head)), *map(self.__getitem__, words)])

    def __missing__(self, word: str) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            if word.isascii() and word.isalpha():  # its letters stand for themselves
                ids = array("I", [t.id for t in self._model.tokenize(self._space + word)]).tobytes()
            elif "\n" in word:  # the words on either side of a line break seldom meet again
                return self._lines(word)
            else:
                ids = self._word(word)
        # Words asked for again outlive those that were not.
        if len(self) >= CACHE_ENTRIES:
            self._old = {}
            self._old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            if _PLAIN.fullmatch(word):
                return self._tokenized(" " + word)
        elif word[-1:] in _MARKS and (stem := word[:-1]).isalpha() and (stem.isascii() or _PLAIN.fullmatch(stem)):
            return self[stem] + (self._pieces.get(word[-1]) or self._piece(word[-1]))
        return self._chunk(" " + word)

    def _lines(self, word: str) -> bytes:
        """Ids of a word with line breaks in it."""
        head, *rest = word.split("\n")
        if not (head and head.isascii() and head.isprintable() and all(map(_LINE.fullmatch, rest))):
            head, *rest = _AT_LINE.split(" " + word)
            return (self._chunk(head) if "\n" in head else self[head[1:]]) + b"".join(map(self._chunk, rest))
        found, get = [self[head]], self._pieces.get
        for line in rest:
            for piece in ("\n", line) if line.isalpha() else ("\n", line[:-1], line[-1]):
                found.append(get(piece) or self._piece(piece))
        return b"".join(found)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, whatever comes before and after it."""
        if "<|" in chunk or not _PLAIN.fullmatch(chunk):
            return packed(self._tokenizer.encode(chunk, add_special_tokens=False).ids)
        pieces = (_ASCII_PIECES if chunk.isascii() else _PIECES).findall(chunk)
        return b"".join([self._pieces.get(p) or self._piece(p) for p in pieces])

    def _piece(self, piece: str) -> bytes:
        if piece[:1] == " " and piece[1:].isalpha():
            return self[piece[1:]]
        if len(self._pieces) >= CACHE_ENTRIES:
            self._pieces.clear()
        self._pieces[piece] = ids = self._tokenized(piece)
        return ids

    def _tokenized(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            named = piece.replace(" ", self._space)  # all others stand for themselves
        else:
            named = charmap_decode(piece.encode(), "strict", self._names)[0]
        return array("I", [t.id for t in self._model.tokenize(named)]).tobytes()


def _irregular(text: str) -> bool:
    """Whether some space does not follow a character that surely is no white space."""
    if "  " in text or "\n " in text or text[:1] == " ":
        return True
    data = text.encode()
    return len(data.translate(None, _RARE)) < len(data) and _IRREGULAR.search(text) is not None


def _chunks(text: str) -> list[str]:
    return [c for part in _AT_SPACE.split(text) for c in _AT_LINE.split(part)]

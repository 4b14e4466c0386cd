"""Token ids of whole texts by the tokenizers library, one distinct word at a time."""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache

_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte: printable ones of
    Latin-1 stand for themselves, the others take the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


_LETTERS = _byte_letters()


class _Words(dict):
    """Ids of a word, as little-endian unsigned 32-bit integers. Keeps the words of the last
    room to 2 * room misses."""

    def __init__(self, path: str, room: int = 600_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.old = Tokenizer.from_file(path), room, {}
        self.model = self.tokenizer.model

    def encode(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # one run of letters goes to the model as it is
            return array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        text = word.decode("utf-8", "replace")
        if max(text) < "԰" and text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_LETTERS))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word[-1] in _TAIL and (core := word.rstrip(_TAIL)) and core[-1] in _ALNUM and b"<|" not in word:  # signs that end a word are encoded apart
                ids = (self.get(core) or self.old.get(core) or self.encode(core)) + self[word[len(core) :]]
            else:
                ids = self.encode(word)
        if len(word) <= 48:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def encode_words(path: str, text: str | None) -> bytes:
    """The text's ids, little-endian unsigned 32-bit. Null and empty texts have none.

    For byte-level vocabularies that lower-case, drop white space and split at it and between
    letters and other signs, as word_bpe_49k.json: there no token, normal form or special token
    crosses an ASCII space, so words are encoded apart and equal words once per Python worker (a
    bounded number is kept)."""
    if not text:
        return b""
    raw = text.encode("utf-8", "replace")
    if b"<|" not in raw:  # special tokens are told by case
        raw = raw.lower()
    return b"".join(map(_words(path).__getitem__, raw.split()))

"""Token ids by the tokenizers library, with what it gave for a word kept for the next time.

Both vocabularies never merge across the boundaries used here, so a text's ids are those of its words
one after the other. What is cached is bounded and belongs to the Python worker.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# Words kept in each of two generations, a few hundred bytes each; a full generation becomes the older one, whose
# words are taken over when met again.
KEPT_WORDS = 250_000
# Letters whose Unicode class and lower case are the same in every version of the tables.
_LAST_LETTER = "ɏ"
_STOPS = (",", ".")


def _byte_letters() -> dict[int, int]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain)) | {b: 256 + k for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _plain(word: str) -> bool:
    """Letters only, of the well-known alphabets and composed: one match, and nothing to normalise but case."""
    return word.isalpha() and (word.isascii() or (max(word) <= _LAST_LETTER and "İ" not in word))


class _Words(dict):
    """Word -> bytes of its ids; words not yet met are encoded by ``_new``."""

    def __init__(self, library: Tokenizer, kept: int):
        super().__init__()
        self._kept = kept
        self._library, self._merge = library, library.model.tokenize
        self._older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def match_ids(self, match: str) -> bytes:
        """Of text that is known to be one match of the library's pattern and normalised."""
        if not match.isascii() or match[0] == " ":
            match = match.encode().decode("latin-1").translate(_LETTERS)
        found = [t.id for t in self._merge(match)]
        return struct.pack(f"<{len(found)}I", *found)

    def _new(self, word: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, word: str) -> bytes:
        found = self._older.get(word)
        if found is None:
            found = self._new(word)
        if len(self) >= self._kept:
            self._older = dict(self)
            self.clear()
        self[word] = found
        return found


def _stopped(word: str) -> bool:
    """A letter and then one stop at the end: always two matches."""
    return len(word) > 1 and word[-1] in _STOPS and _plain(word[-2])


class _Starts(_Words):
    """Words as they stand at the start of a text or line."""

    def _new(self, word: str) -> bytes:
        if _plain(word):
            return self.match_ids(word)
        if _stopped(word):
            return self[word[:-1]] + self[word[-1]]
        return self.ids(word)


class _Spaced(_Words):
    """Words with the one space before them; a lone line break inside is a match of its own."""

    def __init__(self, library: Tokenizer, kept: int, starts: _Starts):
        super().__init__(library, kept)
        self._starts = starts

    def _new(self, word: str) -> bytes:
        if _plain(word):
            return self.match_ids(" " + word)
        if _stopped(word):
            return self[word[:-1]] + self._starts[word[-1]]
        before, line, after = word.partition("\n")
        if line and before and after and not before[-1].isspace() and not after[0].isspace():
            return self[before] + self._starts["\n"] + self._starts[after]
        return self.ids(" " + word)


class _Bare(_Words):
    """Words of a vocabulary that drops white space and lower-cases."""

    def _new(self, word: str) -> bytes:
        if _plain(word):
            lower = word.lower()
            return self.match_ids(word) if lower == word else self[lower]
        if _stopped(word):
            return self[word[:-1]] + self[word[-1]]
        return self.ids(word)


_ODD = re.compile(r" \s")
_SAFE = re.compile(r" (?=\S)")
_CONTROL = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[\x20\x09-\x0d]+")


class _Encoder:
    """Ids of texts. The vocabulary's special strings are tokens of their own wherever they stand, and what is between
    them is encoded as texts are."""

    def __init__(self, library: Tokenizer):
        self._special = {}
        for i, t in library.get_added_tokens_decoder().items():
            if t.lstrip or t.rstrip or t.single_word or t.normalized:
                raise ValueError(f"special string {t.content!r} takes more than itself")
            self._special[t.content] = struct.pack("<I", i)
        longest_first = sorted(self._special, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def _between(self, text: str) -> bytes:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self._special):
            return self._between(text)
        parts = self._split.split(text)
        return b"".join(self._special[p] if k % 2 else self._between(p) for k, p in enumerate(parts) if p)


class ByteLevel(_Encoder):
    """Byte-level BPE: a match begins before every single space that a visible character follows."""

    def __init__(self, path: str, kept: int):
        library = _library(path)
        super().__init__(library)
        self._starts = _Starts(library, kept)
        self._spaced = _Spaced(library, kept, self._starts)

    def _between(self, text: str) -> bytes:
        words = _SAFE.split(text) if _ODD.search(text) or text.endswith(" ") else text.split(" ")
        return self._starts[words[0]] + b"".join(map(self._spaced.__getitem__, words[1:]))


class WordLevel(_Encoder):
    """BPE with word ends: white space only separates."""

    def __init__(self, path: str, kept: int):
        library = _library(path)
        super().__init__(library)
        self._words = _Bare(library, kept)

    def _between(self, text: str) -> bytes:
        words = _BLANKS.split(text) if _CONTROL.search(text) else text.split()
        return b"".join(map(self._words.__getitem__, words))


def _library(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def byte_level(path: str, kept: int = KEPT_WORDS) -> ByteLevel:
    return ByteLevel(path, kept)


@lru_cache(maxsize=4)
def word_level(path: str, kept: int = KEPT_WORDS) -> WordLevel:
    return WordLevel(path, kept)

"""Ids of whole texts by a word-level tokenizer file, white-space piece by white-space piece.

The tokenizer drops white space and merges nothing across it, so the ids of a text are those of its
pieces one after another, and a worker keeps the ids of pieces it has met. A new piece goes to the
library; one of plain Latin letters, alone or before a comma or full stop, is known to be one word and
skips the library's normalizing and splitting. Tokenizers for which the first sentence does not hold
must set ``whole=True``.
"""

from __future__ import annotations

import json
from array import array

from .common import worker_state

# Pieces whose ids a worker keeps; when full it starts anew, which changes no result.
CACHED = 1_000_000
# Letters below this one (Latin) have one-to-one lower case and are in every version of Unicode.
_LATIN = "ɐ"
# Characters that str.split() takes for white space and the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class WordIds(dict):
    """Piece to its ids as 32-bit integers."""

    def __init__(self, path: str, whole: bool = False, cached: int = CACHED):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.whole, self.cached = whole, cached
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # A run of letters is one word for such a tokenizer, in lower case.
        steps = [s["type"] for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        lowers = "Lowercase" in [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        self.letter_runs = lowers and steps == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.words = self.tokenizer.model.tokenize
        self.letters = _byte_letters()

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, piece: str) -> bytes:
        if self.letter_runs and piece.isalpha() and (piece.isascii() or max(piece) < _LATIN):
            word = piece.lower()
            if word.isalpha():
                if not word.isascii():
                    word = "".join(map(self.letters.__getitem__, word.encode()))
                return array("I", [token.id for token in self.words(word)]).tobytes()
        return self._library(piece)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.cached:
            self.clear()
        stem = piece[:-1]
        if piece[-1] in ",." and stem.isalpha():
            # A mark behind letters is a word of its own.
            ids = (self.get(stem) or self._ids(stem)) + self[piece[-1]]
        else:
            ids = self._ids(piece)
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if self.whole or any(c in text for c in _SEPARATORS):
            return self._library(text)
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(path: str, whole: bool = False, cached: int = CACHED) -> WordIds:
    """The worker's encoder for one tokenizer file."""
    return worker_state(f"words {path} {whole} {cached}", lambda: WordIds(path, whole, cached))

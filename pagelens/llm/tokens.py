"""Exact token ids through a tokenizers file, memoised per white-space word.

The vocabulary file is a parameter and is loaded once per Python worker.
Where the file's pipeline treats white-space separated words independently
(NFC, white-space collapse, lower case, a pattern that never crosses white
space, byte-level BPE with word ends), ids of a text are the concatenated ids
of its words, so each distinct word is encoded once per worker and looked up
afterwards. Any other file, and any text with a control character on which
Python's and the library's notions of white space differ, goes to the library
as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np

#: Words kept in a worker's memo before it starts anew (about 200 bytes each).
MEMO_WORDS = 300_000
_odd_space = re.compile("[\x1c-\x1f\u180e]")
_loaded: dict[str, WordIds] = {}


def _ranges(kind: str, last: int = 0x17F) -> str:
    return "".join(re.escape(chr(c)) for c in range(last + 1) if unicodedata.category(chr(c))[0] == kind)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: printable Latin-1 stays, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """A bounded dictionary that fills itself; it starts anew when full."""

    def __init__(self, make, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self.make(key)
        if len(key) <= 64:
            self[key] = got
        return got


class WordIds:
    """Token ids of texts under one tokenizers file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        small = self.tok.get_vocab_size() <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.by_word = self._words_are_independent(spec) and sys.byteorder == "little"
        letters, numbers = _ranges("L"), _ranges("N")
        #: The file's own split pattern, over Latin text in lower case without white space.
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall
        self.beyond = re.compile("|".join(["[^\x00-\u012f\u0131-\u017f]", *(re.escape(t["content"]) for t in spec.get("added_tokens", []))])).search
        self.alphabet = byte_alphabet()
        self.tokenize = self.tok.model.tokenize
        self.words, self.parts = _Memo(self._word), _Memo(self._part)

    @staticmethod
    def _words_are_independent(spec: dict) -> bool:
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return norm == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>"

    def whole(self, text: str) -> bytes:
        """The library's own ids of a text."""
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(self.alphabet[b] for b in piece.encode())
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.beyond(word):
            return self.whole(word)
        return b"".join(map(self.parts.__getitem__, self.pieces(word.lower())))

    def encode(self, text: str) -> bytes:
        """Little-endian ids of the whole text, ``dtype`` wide, without special tokens added."""
        if not self.by_word or _odd_space.search(text):
            return self.whole(text) if text else b""
        return b"".join(map(self.words.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

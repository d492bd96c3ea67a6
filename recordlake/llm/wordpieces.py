"""Exact ids of a word-end BPE tokenizer file, with each different word encoded once a worker.

White space separates words for such a tokenizer (it is dropped, and normal form C, lower case and the
split pattern act inside a word), so a text's ids are its words' ids in a row. Words of common Latin
letters, digits and ASCII signs are split by the file's own pattern and encoded by its BPE model; any
other word (other scripts, combining marks, unusual white space, special tokens) goes through the whole
tokenizer. A file with another normal form or split pattern than the ones written here goes through the library, text
by text. The cache is bounded: it starts anew when full.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

PLAIN = re.compile(r"[!-~À-ÖØ-öø-į]+")
#: the split pattern of the tokenizer file for words that PLAIN takes
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-į]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-į]+")

#: fixed values: what a tokenizer file must say for its words to be encoded one by one
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that this module knows: then ids of words in a row are ids of the text."""
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, model = steps[0], settings.get("model") or {}
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    rest = [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    plain = not settings.get("post_processor") and model.get("type") == "BPE" and not model.get("dropout")
    return split and rest and plain and settings.get("normalizer") == NORMALIZER and not any(" " in t["content"] for t in settings.get("added_tokens") or ())


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Known(dict):
    """The ids of words; one that is not there is encoded. It starts anew when full."""

    def __init__(self, encode: Callable[[bytes], bytes], room: int) -> None:
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        if len(self) >= self.room:
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str, room: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            self.by_word = splits_at_spaces(json.load(file))
        self.letters = _byte_letters()
        self.known = _Known(self._word, room)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self._whole(text)
        parts = SPLIT.findall(text.lower())
        if parts != [text]:  # parts are words too, and often known
            return b"".join([self.known[part.encode()] for part in parts])
        shown = text if text.isascii() else "".join([self.letters[b] for b in word])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, unsigned 32-bit little-endian."""
        if not self.by_word:
            return self._whole(text)
        known = self.known
        return b"".join([known[w] for w in text.encode().split()])

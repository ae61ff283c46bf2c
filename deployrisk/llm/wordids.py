"""Token ids of texts by the tokenizers library, with whole words remembered.

Two kinds of tokenizers encode a word the same wherever it stands, given the white space before it:

* byte-level ones without a normaliser: words are cut before a space that follows anything but white space;
* ones that drop white space and change letters one by one: words are cut at white space.

For these, the ids of a text are its words' ids joined. Words of letters alone go straight to the model,
any other word through the whole tokenizer. All other tokenizers, and texts in which white space meets a
space, are encoded whole.
"""

from __future__ import annotations

import json
import re
import string
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

#: White space as Python sees it, which takes in all that the patterns of the tokenizers call so.
_MARKS = string.punctuation.replace("'", "")
_BEFORE_SPACE = re.compile(r"\s ")
_WORDS_DROPPED = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LETTERS_CHANGED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}

#: Byte-level models see each byte as a printable character: itself if it is one, else the next from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds(dict):
    """Little-endian ids by word (UTF-8 where white space is dropped); up to ``most`` words are remembered."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.model, self.heads = most, self.tokenizer.model, {}
        parts = json.loads(self.tokenizer.to_str())
        self.kind = "whole"
        stripping = any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in parts["added_tokens"])
        if parts["model"]["type"] == "BPE" and not parts["model"]["dropout"] and not stripping:
            before = parts["pre_tokenizer"]
            if parts["normalizer"] is None and before == {**_BYTES, "use_regex": True}:
                self.kind = "spaces kept"
            elif ((parts["normalizer"] or {}).get("normalizers") == _LETTERS_CHANGED
                  and before.get("pretokenizers") == [_WORDS_DROPPED, {**_BYTES, "use_regex": False}]):
                self.kind = "spaces dropped"
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.before = " " if self.kind == "spaces kept" else ""

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def head(self, text: str) -> bytes:
        """Ids of a word with nothing before it."""
        found = self.heads.get(text)
        if found is None:
            found = self.letters(text, "") if self.is_letters(text) else self.whole(text)
            if len(self.heads) < self.most // 8:
                self.heads[text] = found
        return found

    @staticmethod
    def is_letters(text: str) -> bool:
        """Letters that every version of Unicode knows, each of one lower-case letter."""
        return text.isalpha() and (text.isascii() or max(text) < "ɐ" and "İ" not in text)

    def letters(self, text: str, before: str) -> bytes:
        if self.kind == "spaces dropped":
            text = text.lower()
        shown = text if text.isascii() else "".join(map(_SHOWN.__getitem__, text.encode()))
        return self.pack([t.id for t in self.model.tokenize(_SHOWN[32] + shown if before else shown)])

    def __missing__(self, word: str | bytes) -> bytes:
        text = word if isinstance(word, str) else word.decode()
        core = text.rstrip(_MARKS)
        if self.is_letters(core):  # then marks are a token of their own, as no contraction begins with one
            if len(core) < len(text):
                value = self[core if word is text else core.encode()] + self.head(text[len(core):])
            else:
                value = self.letters(core, self.before)
        elif self.before and "\n" in text and (lines := text.split("\n")) == text.split():
            value = self.head("\n").join([self[lines[0]], *map(self.head, lines[1:])])  # a single line end stands alone
        else:
            value = self.whole(self.before + text)
        if len(self) < self.most:
            self[word] = value
        return value

    def encode(self, text: str) -> bytes:
        """Ids of a whole text in this tokenizer's ``dtype``."""
        if self.kind == "whole" or not text:
            return self.whole(text)
        if self.kind == "spaces dropped":
            return b"".join(map(self.__getitem__, text.encode().split()))
        if _BEFORE_SPACE.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.head(first) + b"".join(map(self.__getitem__, rest))


_OPEN: dict[str, WordIds] = {}


def opened(path: str) -> WordIds:
    """One for each tokenizer file in a worker process."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]

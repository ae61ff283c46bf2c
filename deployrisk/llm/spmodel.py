"""Reading a SentencePiece model file: the few protobuf fields that decide how texts are encoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Piece kinds and model kinds, as numbered in the file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True

    def crosses_words(self) -> bool:
        """Whether some piece holds a space after another character, so that words can't be encoded one by one."""
        return any(SPACE in p.lstrip(SPACE) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire}")
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> Model:
    model = Model()
    with open(path, "rb") as file:
        data = file.read()
    for number, value in _fields(data):
        if number == 1:
            parts = dict(_fields(value))
            score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
            model.pieces.append((parts.get(1, b"").decode(), score, parts.get(3, NORMAL)))
        elif number == 2:
            parts = dict(_fields(value))
            model.kind, model.byte_fallback = parts.get(3, UNIGRAM), bool(parts.get(35, 0))
        elif number == 3:
            parts = dict(_fields(value))
            model.charsmap, model.dummy_prefix = parts.get(2, b""), bool(parts.get(3, 1))
            model.squeeze_spaces = bool(parts.get(4, 1))
    return model

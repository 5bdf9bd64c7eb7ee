"""Vocabularies in SentencePiece's model file and the cutting of texts into marked words."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import public_tokenizers

#: Fixed values of the model format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

DEFAULT_MODEL = "piece_bpe_32k.model"


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_MODEL)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


@dataclass
class Vocabulary:
    """Pieces that texts can be cut into, byte pieces, and how texts are prepared."""

    ids: dict[str, int] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)
    strings: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    bytes_: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True

    def __post_init__(self) -> None:
        self.finish()

    def finish(self) -> None:
        self.longest = max(map(len, self.ids), default=1)
        #: Rank of a piece among merges: higher scores merge first.
        order = sorted(set(self.scores.values()), reverse=True)
        place = {s: i for i, s in enumerate(order)}
        self.ranks = {p: place[s] for p, s in self.scores.items()}
        #: Lengths of the pieces that end in two given characters, the longest first.
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: sorted(n, reverse=True) for e, n in ends.items() if len(e) == 2}
        #: What decoding writes for each id.
        byte = {i: bytes([b]) for b, i in self.bytes_.items()}
        silent = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.spelled = [b"" if i in silent else byte.get(i, p.encode()) for i, p in enumerate(self.strings)]
        if self.spelled:
            self.spelled[self.unknown] = " ⁇ ".encode()
        newline = not any("\n" in p for p in self.ids)
        self.cutter = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if newline else f"{MARK}*[^{MARK}]+|{MARK}+")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that cross a word boundary are not supported")

    def marked_words(self, text: str) -> list[str]:
        """The text with blanks as marks, cut before every run of marks; no piece crosses a cut."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return self.cutter.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        if self.byte_fallback:
            return [self.bytes_[b] for b in char.encode()]
        return [self.unknown]


def parse(data: bytes) -> Vocabulary:
    v = Vocabulary()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, x in _fields(value):
                if n == 1:
                    piece = x.decode()
                elif n == 2:
                    score = struct.unpack("<f", x)[0]
                elif n == 3:
                    kind = x
            i = len(v.strings)
            v.strings.append(piece)
            v.kinds.append(kind)
            if kind in (NORMAL, UNUSED):
                v.ids[piece], v.scores[piece] = i, score
            elif kind == BYTE:
                v.bytes_[int(piece[3:5], 16)] = i
            elif kind == UNKNOWN:
                v.unknown = i
            elif kind == USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
        elif number == 2:
            spec = dict(_fields(value))
            v.model_type = spec.get(3, UNIGRAM)
            v.byte_fallback = bool(spec.get(35, 0))
            if spec.get(24, 0):
                raise ValueError("marks at the end of words are not supported")
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(2):
                raise ValueError("only identity normalisation is supported")
            v.dummy_prefix, v.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if v.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models are supported")
    v.finish()
    return v


@lru_cache(maxsize=4)
def loaded(data: bytes) -> Vocabulary:
    """A worker parses each model once."""
    return parse(data)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()

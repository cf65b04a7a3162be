"""Tables of a byte-fallback BPE piece model, read from its file: what may merge, how soon, into which id."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
NEVER = np.int32(np.iinfo(np.int32).max)
# Fixed values of the model file: field numbers, kinds of pieces and of models, and their defaults.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, SUFFIX_SPACE, BYTE_FALLBACK, UNKNOWN_SURFACE, BEGIN_PIECE, END_PIECE = 3, 24, 35, 44, 46, 47
CHARS_MAP, DUMMY_PREFIX, DROP_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message; nested ones stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


def _wide(symbols: np.ndarray, width: int) -> np.ndarray:
    return symbols.astype(np.int64) * width


@dataclass(frozen=True)
class PieceModel:
    """Arrays of a piece model; symbols 0 to n-1 are its strings, n + c an unknown character c.

    Bounded by the vocabulary. `rank` orders merges by the score of the merged piece (equal scores
    share a rank); `linked` marks the pairs of neighbouring characters that some piece holds, as
    bits: nothing ever merges across any other pair.
    """

    alphabet: np.ndarray
    char_symbol: np.ndarray
    linked: np.ndarray
    pair_keys: np.ndarray
    pair_symbol: np.ndarray
    rank: np.ndarray
    symbol_id: np.ndarray
    byte_ids: np.ndarray
    surfaces: tuple[bytes, ...]
    kinds: bytes
    begin: int
    end: int
    dummy_prefix: bool

    @property
    def symbols(self) -> int:
        return len(self.rank)

    def char_table(self) -> np.ndarray:
        """Place of each code point in the alphabet, -1 for the others."""
        table = np.full(0x110000, -1, dtype=np.int32)
        table[self.alphabet] = np.arange(len(self.alphabet), dtype=np.int32)
        return table

    def symbols_of(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        known = self.char_symbol[np.maximum(places, 0)]
        return np.where(places >= 0, known, self.symbols + codes.astype(np.int64)).astype(np.int32)

    def cuts(self, places: np.ndarray) -> np.ndarray:
        """Whether nothing can merge across the place before each character (always so at the first)."""
        left, right = places[:-1], places[1:]
        key = _wide(np.maximum(left, 0), len(self.alphabet)) + np.maximum(right, 0)
        linked = (self.linked[key >> 3] >> (key & 7).astype(np.uint8)) & 1
        return np.concatenate([[True], (linked == 0) | (left < 0) | (right < 0)])

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, -1 where it makes none."""
        key = _wide(left, self.symbols) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (left < self.symbols) & (right < self.symbols)
        return np.where(found, self.pair_symbol[at], -1).astype(np.int32)

    def rank_of(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.rank[np.maximum(merged, 0)], NEVER)


def load(path: str) -> PieceModel:
    """Read a model file on the driver.

    Models that this operator has no rules for raise ValueError: other kinds than BPE, no byte
    pieces, user-defined or unused pieces, a character map, or other treatment of spaces than one
    escaped space per space.
    """
    with open(path, "rb") as file:
        top = list(fields(file.read()))
    trainer = {n: v for key, value in top if key == TRAINER for n, v in fields(value)}
    normalizer = {n: v for key, value in top if key == NORMALIZER for n, v in fields(value)}
    pieces = []
    for key, value in top:
        if key == PIECES:
            part = dict(fields(value))
            score = struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0]
            pieces.append((part.get(1, b"").decode(), score, part.get(3, NORMAL)))
    kinds = bytes(kind for _, _, kind in pieces)
    plain_spaces = (
        not normalizer.get(DROP_SPACES, 1) and normalizer.get(ESCAPE_SPACES, 1) and not trainer.get(SUFFIX_SPACE, 0)
    )
    if (
        trainer.get(MODEL_TYPE, 1) != BPE
        or not trainer.get(BYTE_FALLBACK, 0)
        or kinds.count(BYTE) != 256
        or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}
        or normalizer.get(CHARS_MAP)
        or not plain_spaces
    ):
        raise ValueError("only BPE models with byte fallback, plain spaces and no character map are encoded")

    names = [text for text, _, _ in pieces]
    vocabulary = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
    letters = sorted({c for text in vocabulary for c in text})
    strings = list(vocabulary) + [c for c in letters if c not in vocabulary]
    symbol = {text: i for i, text in enumerate(strings)}
    scores = np.array([pieces[vocabulary[t]][1] if t in vocabulary else -np.inf for t in strings])
    _, rank = np.unique(-scores, return_inverse=True)
    pairs = sorted(
        (symbol[t[:i]] * len(strings) + symbol[t[i:]], symbol[t])
        for t in vocabulary
        for i in range(1, len(t))
        if t[:i] in symbol and t[i:] in symbol
    )
    place = {c: i for i, c in enumerate(letters)}
    linked = np.zeros(len(letters) ** 2, dtype=bool)
    linked[[place[a] * len(letters) + place[b] for t in vocabulary for a, b in zip(t, t[1:], strict=False)]] = True
    unknown = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode())
    surface = {
        NORMAL: lambda text: text.replace(SPACE, " ").encode(),
        BYTE: lambda text: bytes([int(text[3:5], 16)]),
        CONTROL: lambda text: b"",
        UNKNOWN: lambda text: unknown,
    }
    return PieceModel(
        alphabet=np.array([ord(c) for c in letters], dtype=np.int64),
        char_symbol=np.array([symbol[c] for c in letters], dtype=np.int32),
        linked=np.packbits(linked, bitorder="little"),
        pair_keys=np.array([key for key, _ in pairs], dtype=np.int64),
        pair_symbol=np.array([value for _, value in pairs], dtype=np.int32),
        rank=rank.astype(np.int32),
        symbol_id=np.array([vocabulary.get(t, -1) for t in strings], dtype=np.int32),
        byte_ids=np.array([names.index(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32),
        surfaces=tuple(surface[kind](text) for text, _, kind in pieces),
        kinds=kinds,
        begin=names.index(trainer.get(BEGIN_PIECE, b"<s>").decode()),
        end=names.index(trainer.get(END_PIECE, b"</s>").decode()),
        dummy_prefix=bool(normalizer.get(DUMMY_PREFIX, 1)),
    )

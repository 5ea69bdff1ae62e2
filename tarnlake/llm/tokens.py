"""Token ids of whole texts, one encoding per distinct run of characters and worker.

The byte-level tokenizer cuts a text into words before it merges bytes, so a text may be cut in advance at any
place where it always cuts itself: before white space that follows a character which is none, and after
a run of plain letters before a sign that is no letter. Many texts are cut at once, by NumPy over their bytes. Arrow
finds the distinct pieces; these are encoded by the tokenizers library and remembered in a table of bounded
size; and Arrow puts their ids in the order of the texts. A text with rarer white space is encoded as a whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tarnlake.llm.common import Remembered

_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_RARE_SPACE = re.compile("[" + "".join(map(chr, (
    0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000, 0xFEFF))) + "]")
# Ends a text among others; no text in UTF-8 holds this byte.
_END = b"\xff"


def _among(values: bytes) -> np.ndarray:
    """For each byte, whether it is among ``values``."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_SPACE = _among(b" \n\t\r")
_SIGN = _among(b".,:;!?()*$%&#|<>@\"/=+")
_ASCII_LETTER = _among(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)))
# The letters from U+00C0 to U+00FF are 0xC3 with one of these; the two left out are signs.
_LATIN_LEAD, _LATIN = 0xC3, _among(bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary of a byte-level tokenizer."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cuts(data: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of texts that each end with ``_END``, which is a piece of its own.

    A piece starts at a text's first byte, at white space after another byte, and at a sign after letters that
    begin their piece, be it with one blank before them.
    """
    space, end = _SPACE[data], data == _END[0]
    start = space.copy()
    start[1:] &= ~space[:-1]
    start |= end
    start[0] = True
    start[1:] |= end[:-1]
    letter = _ASCII_LETTER[data]
    second = np.flatnonzero(data == _LATIN_LEAD) + 1  # a lead byte is never the last one
    second = second[_LATIN[data[second]]]
    letter[second] = letter[second - 1] = True
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edges = np.concatenate([[0], edges])
    first, after = edges[::2], edges[1::2]  # every run of letters is followed by something, at least an end
    before = np.maximum(first - 1, 0)
    leads = start[first] | (start[before] & (data[before] == 0x20))
    start[after[leads & _SIGN[data[after]]]] = True
    return np.flatnonzero(start)


class ByteLevelEncoder(Remembered):
    """Maps a piece of text in UTF-8 to its ids as little-endian 16-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def result(self, piece: bytes) -> bytes:
        text = piece.decode()
        word = text[1:] if text[0] == " " else text
        # One word for the model, so the steps around it can be left out.
        if word.isascii() and word.isalpha():
            ids = [token.id for token in self.model.tokenize(text.replace(" ", self.letters[0x20]))]
        elif _LETTERS.fullmatch(text):
            ids = [token.id for token in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def ended(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        """The ids of each whole text and ``end_id`` after them; a null is empty."""
        if not texts:
            return []
        rare = {k for k, text in enumerate(texts) if text and _RARE_SPACE.search(text)}
        blob = b"".join((b"" if k in rare or not text else text.encode()) + _END for k, text in enumerate(texts))
        data = np.frombuffer(blob, np.uint8)
        starts = cuts(data)
        offsets = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(blob)]).dictionary_encode()
        distinct = pieces.dictionary
        chars = distinct.buffers()[2].to_pybytes()
        at = np.frombuffer(distinct.buffers()[1], np.int64)[:len(distinct) + 1].tolist()
        end = np.array([end_id], "<u2")
        found = [end.tobytes() if piece == _END else self[piece] for piece in (chars[a:b] for a, b in zip(at, at[1:]))]
        joined = pa.array(found, pa.large_binary()).take(pieces.indices)
        ids = np.frombuffer(joined.buffers()[2], "<u2")
        upto = np.frombuffer(joined.buffers()[1], np.int64)[np.flatnonzero(data[starts] == _END[0]) + 1] // 2
        parts = np.split(ids[:upto[-1]], upto[:-1])
        for k in rare:
            whole = self.tokenizer.encode(texts[k], add_special_tokens=False).ids
            parts[k] = np.concatenate([np.array(whole, "<u2"), end])
        return parts


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevelEncoder:
    """The encoder of this Python worker; it outlives a task."""
    return ByteLevelEncoder(path)

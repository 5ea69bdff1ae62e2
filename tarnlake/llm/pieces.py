"""SentencePiece encoding and decoding of byte-pair models by a weighted transducer and its shortest path.

Three transducers are compiled from the model file:

* the normaliser: spaces become ``▁``, one is put in front, runs of spaces become one where the model says so;
* the pieces: a state for every beginning of a piece, an arc for every character that goes on, an output where a piece ends;
* the bytes: an arc for every character that is no piece, whose outputs are the pieces of its bytes.

They are composed with each text as it is read. A state of the composition is a place in the normalised text and the
last piece before it; its arcs are the pieces, or bytes, that follow. An arc weighs one if the merges would not keep the boundary
between the two pieces, else nothing. Weights are those of the tropical semiring: they add up along a path, and the least one counts.
A row of pieces is the encoding exactly if the merges keep each of its boundaries, and only one row is so. The shortest path
therefore weighs nothing and is the encoding. The scores in the file can't be the weights: in a byte-pair model they
are the order of the merges, and the path of the best sum is another one.

A text is cut beforehand where no piece of the vocabulary joins the two characters, which no path can cross, and where the
normaliser is in the same state; what is between two cuts is encoded once per worker and remembered in a table of bounded size.

Edge cases: a null or empty text has no pieces and decodes to an empty text; equal rows give equal results;
ids outside the vocabulary are refused in decoding. Only the id and the text are read, so no names clash.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import Remembered, map_arrow, slices, vocabulary

SPACE = "▁"
# Kinds of pieces in a model file.
NORMAL, BYTE = 1, 6
# Boundaries whose weight is known, per worker; a full table is emptied.
REMEMBERED_WEIGHTS = 400_000
# No piece: what precedes the first one, and a character that is spelled by its bytes. No merge reaches across either.
NONE = -1
# Bits of a character, and of a piece and one, in the keys of arcs and states.
_CHARACTER, _PIECE = 21, 17
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = ".,:;!?()*$%&#|<>@\"=+"


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


class Normaliser:
    """The transducer from characters to normalised characters.

    It is at the start, inside the text, or in a gap of spaces that it has read and not written. ``arcs`` has, by state
    and by whether a character is a space, the next state, what is written, and whether the character itself is.
    """

    START, INSIDE, GAP = range(3)

    def __init__(self, dummy: bool, squeeze: bool):
        front = SPACE if dummy else ""
        if squeeze:
            self.arcs = (
                ((self.INSIDE, front, True), (self.START, "", False)),
                ((self.INSIDE, "", True), (self.GAP, "", False)),
                ((self.INSIDE, SPACE, True), (self.GAP, "", False)),
            )
        else:
            self.arcs = (
                ((self.INSIDE, front, True), (self.INSIDE, front + SPACE, False)),
                ((self.INSIDE, "", True), (self.INSIDE, SPACE, False)),
            )

    def run(self, text: str, state: int) -> str:
        """What is written for a text that is read from a state on; a gap at its end is never written."""
        out, arcs = [], self.arcs
        for character in text:
            state, written, itself = arcs[state][character == " "]
            out.append(written + character if itself else written)
        return "".join(out)


class Pieces:
    """The transducer from characters to pieces: a tree of their beginnings, with the arcs of all states in one table."""

    def __init__(self, pieces: dict[str, int]):
        self.next: dict[int, int] = {}
        self.output = array("i", [NONE])
        for text, piece in pieces.items():
            state = 0
            for character in text:
                state = self.next.setdefault(state << _CHARACTER | ord(character), len(self.output))
                if state == len(self.output):
                    self.output.append(NONE)
            self.output[state] = piece

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """The pieces that the text has at a place, short ones first, and where each ends."""
        found, state, after, output = [], 0, self.next, self.output
        for end in range(at, len(text)):
            state = after.get(state << _CHARACTER | ord(text[end]), 0)
            if not state:
                break
            if output[state] != NONE:
                found.append((output[state], end + 1))
        return found


class PieceEncoder(Remembered):
    """Maps what lies between two cuts to its ids as little-endian 16-bit integers."""

    # A path costs more than a word of the other encoder, and a worker has the room.
    MOST = 300_000

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        normaliser = dict(_fields(next((v for k, v in model if k == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("only byte-pair models are supported")
        if normaliser.get(2):
            raise ValueError("character maps are not supported")
        self.dummy = bool(normaliser.get(3, 1))
        self.normaliser = Normaliser(self.dummy, bool(normaliser.get(4, 1)))
        self.surface: list[bytes | None] = []
        self.text: list[str] = []
        self.piece: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        for number, entry in enumerate(v for k, v in model if k == 1):
            fields = dict(_fields(entry))
            text, kind = fields.get(1, b"").decode(), fields.get(3, NORMAL)
            self.text.append(text)
            self.surface.append(None)
            if kind == NORMAL:
                self.piece[text] = number
                self.score[text] = struct.unpack("<f", fields.get(2, bytes(4)))[0]
                self.surface[-1] = text.replace(SPACE, " ").encode()
            elif kind == BYTE:
                self.byte[int(text[1:-1], 16)] = number
                self.surface[-1] = bytes([int(text[1:-1], 16)])
        if len(self.surface) > 1 << 16 or len(self.byte) != 256:
            raise ValueError("the ids need 16 bits and there must be a piece for each byte")
        self.pieces = Pieces(self.piece)
        self.weights: dict[int, int] = {}
        joined = {text[k:k + 2] for text in self.piece for k in range(len(text) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in joined) or any("\n" in text for text in self.piece):
            raise ValueError("pieces that go on after a space or hold a line feed are not supported")
        letter = re.compile(f"[{_LETTERS}]")
        signs = "".join(s for s in _SIGNS if not any(pair[1] == s and letter.match(pair[0]) for pair in joined))
        # Each part but the last ends inside the text, so that the next one is normalised alike wherever it occurs.
        self.parts = re.compile(
            f"[ {SPACE}]*+[{_LETTERS}]++(?=[{re.escape(signs)} {SPACE}\n]|$)|[ {SPACE}]*+[^ {SPACE}\n]++"
            f"|[ {SPACE}]*+\n|[ {SPACE}]++")

    def merged(self, text: str) -> list[str]:
        """The characters of a short text after all merges: the best score first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, last: int, piece: int) -> int:
        """What the arc of a piece weighs after the last one: one if the merges would not keep the boundary."""
        if piece == NONE:
            return 0
        key = (last + 1) << 16 | piece
        known = self.weights.get(key)
        if known is None:
            kept = [self.text[p] for p in (last, piece) if p != NONE]
            known = int(self.merged("".join(kept)) != kept)
            if len(self.weights) >= REMEMBERED_WEIGHTS:
                self.weights.clear()
            self.weights[key] = known
        return known

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """The arcs of the composition at a place of a normalised text: pieces, or bytes of a character that is none."""
        spelled = [] if text[at] in self.piece else [(NONE, at + 1)]
        return spelled + self.pieces.arcs(text, at)

    def shortest(self, text: str) -> list[tuple[int, int]]:
        """The pieces of the path of least weight through a normalised text, with the place each ends at.

        States are settled weight by weight, within one weight in depth and along the longest piece first, so that most
        arcs need no weight. Arcs are made again where the search comes back to a state, and those of weight one when all states
        of a weight are settled, so none wait in memory.
        """
        goal = len(text)
        before: dict[int, int] = {0: 0}
        starts, settled = [0], []
        while starts:
            for start in starts:
                path, untried = [start], [NONE]
                while path:
                    state = path[-1]
                    at, last = state >> _PIECE, (state & (1 << _PIECE) - 1) - 1
                    if at == goal:
                        return self._traced(state, before)
                    arcs = self.arcs(text, at)
                    left = len(arcs) if untried[-1] == NONE else untried[-1]
                    while left:
                        left -= 1
                        piece, end = arcs[left]
                        reached = end << _PIECE | piece + 1
                        if reached not in before and not self.weight(last, piece):
                            before[reached] = state
                            untried[-1] = left
                            path.append(reached)
                            untried.append(NONE)
                            break
                    else:
                        settled.append(path.pop())
                        untried.pop()
            starts = []
            for state in settled:
                for piece, end in self.arcs(text, state >> _PIECE):
                    reached = end << _PIECE | piece + 1
                    if reached not in before:
                        before[reached] = state
                        starts.append(reached)
            settled = []
        raise ValueError("the model has a character that is neither a piece nor spelled by bytes")

    @staticmethod
    def _traced(state: int, before: dict[int, int]) -> list[tuple[int, int]]:
        found = []
        while state:
            found.append(((state & (1 << _PIECE) - 1) - 1, state >> _PIECE))
            state = before[state]
        return found[::-1]

    def ids(self, part: str, state: int) -> bytes:
        """The ids of a part of a text that the normaliser reads from a state on."""
        text = self.normaliser.run(part, state)
        ids = []
        for piece, end in self.shortest(text):
            ids += [piece] if piece != NONE else [self.byte[b] for b in text[end - 1].encode()]
        return np.array(ids, "<u2").tobytes()

    def result(self, part: str) -> bytes:
        return self.ids(part, Normaliser.INSIDE)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; a null is empty."""
        parts = self.parts.findall(text or "")
        if not parts:
            return b""
        # The normaliser is inside the text after each part; one of spaces alone is the last.
        return self.ids(parts[0], Normaliser.START) + b"".join(map(self.__getitem__, islice(parts, 1, None)))

    def decode(self, ids: bytes) -> str:
        """The text of the ids, without the space in front."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode(errors="replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker; it outlives a task."""
    return PieceEncoder(path)


def encode(docs: DataFrame, vocabularies: str | None = None) -> DataFrame:
    """doc_id, and the ids of its text as 16-bit integers."""
    path = vocabulary("piece_bpe_32k.model", vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_encoder(path)
        for batch in (s for b in batches for s in slices(b, "text")):
            ids = [model.encode(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabularies: str | None = None) -> DataFrame:
    """doc_id, ids, and the text that the ids spell."""
    path = vocabulary("piece_bpe_32k.model", vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_encoder(path)
        for batch in (s for b in batches for s in slices(b, "ids")):
            texts = [model.decode(ids.as_py()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")


def report(docs: DataFrame, vocabularies: str | None = None) -> DataFrame:
    """Per document the number and checksum of its ids (32 bits each), and the checksum of the text they decode to.

    ``encode``, ``decode`` and the checksums in one pass, so that a task has one worker and one encoder.
    """
    path = vocabulary("piece_bpe_32k.model", vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_encoder(path)
        for batch in (s for b in batches for s in slices(b, "text")):
            ids = [model.encode(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()),
                pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(model.decode(x).encode()) for x in ids], pa.int64()),
            ], ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long")

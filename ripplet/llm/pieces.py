"""Token ids of whole texts by the sentencepiece library, and the bytes that tokens stand for."""

from __future__ import annotations

import re
from array import array

import numpy as np

SPACE = "▁"
#: A line feed or spaces, and what follows up to the next of them.
_PART = re.compile(r"\n[^ \n]*| +[^ \n]*")


class PieceEncoder:
    """Encodes texts as the library does, by parts that are looked up if they came before.

    No piece of the usual vocabularies goes on from another character to a space, or holds a line feed, so what stands
    between is encoded alone with the same ids. That is checked in the vocabulary; for any other, whole texts are encoded.
    The parts that are kept take most_bytes at most, counted with EACH for Python's objects.
    """

    EACH = 200

    def __init__(self, path: str, most_bytes: int = 80_000_000) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.held = most_bytes, 0
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        inner = any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces)
        alone, line = model.encode(" "), model.encode("\na")
        self.space = model.piece_to_id(SPACE)
        self.by_parts = not inner and len(alone) == 1 and line[:1] == [self.space] and model.encode("a ")[-1:] == [self.space]
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        """New parts: those after a space are what the library itself puts a space before."""
        if self.held > self.most:
            self.known, self.held = {}, 0
        for at in range(0, len(parts), 5_000):
            some = parts[at : at + 5_000]
            for part, ids in zip(some, self.model.encode([p if p[0] == "\n" else p[1:] for p in some], num_threads=1), strict=True):
                self.known[part] = array("I", ids[1:] if part[0] == "\n" else ids or [self.space]).tobytes()
        self.held += 2 * sum(map(len, parts)) + self.EACH * len(parts)

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words that follow a space, or that begin with a line feed."""
        found = []
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            for word, ids in zip(some, self.model.encode(some, num_threads=1), strict=True):
                found.append(array("I", ids[1:] if word[0] == "\n" else ids).tobytes())
        return found

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if not self.by_parts:
            return [np.array(x, "<u4") for x in self.model.encode(texts, num_threads=1)]
        parts = [_PART.findall(f" {t}") if t else [] for t in texts]
        held = self.known
        new = set().union(*parts).difference(held)
        if new:
            if self.held > self.most:
                new = set().union(*parts)
            self._learn(list(new))
        look = self.known.__getitem__
        return [np.frombuffer(b"".join(map(look, p)), "<u4") for p in parts]

    def token_bytes(self) -> list[bytes]:
        """What each piece stands for."""
        out = []
        for i, piece in enumerate(self.pieces):
            out.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode())
        return out


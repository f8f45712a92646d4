"""Token ids of whole texts by the tokenizers library, one encoder in each Python worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: Between two characters that aren't white space, one space or line feed always starts a token: what stands on either
#: side of it is encoded alone with the same ids.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Words that are encoded whole: those with separators or letters beyond Latin, whose classes a newer Unicode
#: may change.
_RARE = re.compile("[\x1c-\x1f\x85\xa0]|[^\x00-\u024f]")
_loaded: dict[tuple[str, bool], "Encoder"] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file; the package with the files is asked for it, nothing is copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _shown(byte: int) -> str:
    """The letter that stands for a byte above 127 in a byte-level vocabulary: itself if it prints, else one after 255."""
    unseen = [*range(0x00, 0x21), *range(0x7F, 0xA1), 0xAD]
    return chr(0x100 + unseen.index(byte)) if byte in unseen else chr(byte)


class Encoder:
    """Encodes texts word by word; the ids of a word that came before are looked up. The ids are those of whole texts.

    That holds for byte-level BPE with the usual pattern and nothing before or after it; texts for any other tokenizer are
    encoded whole. The words and pieces that are kept take most_bytes at most, counted with EACH for Python's objects.
    plain: special tokens' strings inside texts are text like other.
    """

    EACH = 200

    def __init__(self, path: str, most_bytes: int = 80_000_000, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.held, self.spelled = Tokenizer.from_file(path), most_bytes, 0, 0
        self.tokenizer.encode_special_tokens = plain
        parts = json.loads(self.tokenizer.to_str())
        first, model = parts["pre_tokenizer"] or {}, parts["model"]
        usual = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        odd = [model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        self.by_words = bool(usual) and model["type"] == "BPE" and not parts["normalizer"] and not any(odd)
        if not self.by_words:
            return
        self.model, self.parts = self.tokenizer.model, regex.compile(public_tokenizers.PATTERN).findall
        self.letters = {b: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        self.letters |= {b: _shown(b) for b in range(128, 256)}
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # the ids of what the tokenizer's pattern parts a word into

    def token_bytes(self) -> list[bytes]:
        """What each token of a byte-level vocabulary stands for; a special token for its own string."""
        back = {self.letters[b]: b for b in range(256)}
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = token.encode() if token in self.special else bytes(map(back.__getitem__, token))
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spell(self, pieces: set[str]) -> None:
        """Takes up the ids of new pieces; byte 255, which is in no text, parts them while bytes become letters."""
        spelled = b"\xff".join(map(str.encode, pieces)).decode("latin-1").translate(self.letters).split(self.letters[255])
        tokenize = self.model.tokenize
        self.pieces.update(zip(pieces, [array("I", [x.id for x in tokenize(p)]).tobytes() for p in spelled], strict=True))
        self.spelled += 2 * sum(map(len, pieces)) + self.EACH * len(pieces)

    def _learn(self, words: list[str], lead: str) -> None:
        """words: new ones, each what follows a space (lead " "), or begins with a line feed (lead "")."""
        mark = lead or "\n"
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            text = lead + lead.join(part)
            if _RARE.search(text) or text.count(mark) > len(part) or any(x in text for x in self.special):
                odd = [w for w in part if mark in w[1:] or _RARE.search(w) or any(x in w for x in self.special)]
                self.known.update((w, self._whole(lead + w)) for w in odd)
                part = [w for w in part if w not in self.known]
                text = lead + lead.join(part)
            if part:
                pieces = self.parts(text)  # only the first of a word has the mark
                if new := set(pieces).difference(self.pieces):
                    self._spell(new)
                ids = list(map(self.pieces.__getitem__, pieces))
                starts = [i for i, x in enumerate(pieces) if x[0] == mark]
                for word, i, j in zip(part, starts, [*starts[1:], len(pieces)], strict=True):
                    self.known[word] = ids[i] if j - i == 1 else b"".join(ids[i:j])
            self.held += 2 * sum(map(len, words[at : at + 5_000])) + self.EACH * 5_000

    def _new(self, words: set[str]) -> list[str]:
        """Those of the words that aren't known; the ids of old ones are taken over."""
        if self.held > self.most:
            self.before, self.known, self.held = self.known, {}, 0
        if self.spelled > self.most:
            self.pieces.clear()
            self.spelled = 0
        new = list(words.difference(self.known))
        if self.before:
            before = self.before
            old = [w for w in new if w in before]
            self.known.update((w, before[w]) for w in old)
            self.held += 2 * sum(map(len, old)) + self.EACH * len(old)
            new = [w for w in new if w not in before]
        return new

    @staticmethod
    def plain_words(text: str) -> list[str]:
        """The words of a text by which words() can encode it, or none if it has more white space than that between them."""
        parts = text.replace("\n", " \n").replace(" \n \n", "\n\n").split(" ")
        return [] if not parts[0] or parts[0][0].isspace() else parts

    @staticmethod
    def odd(words: Iterable[str]) -> set[str]:
        """Those of words that stood next to more white space: with it at an end, other than one line feed before them."""
        return {w for w in words if not w or w[-1].isspace() or w[0].isspace() and (w[0] != "\n" or w[1].isspace())}

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words that follow a space, or that begin with a line feed; none of them odd()."""
        self._learn([w for w in words if w[0] != "\n"], " ")
        self._learn([w for w in words if w[0] == "\n"], "")
        found = list(map(self.known.__getitem__, words))
        self.known, self.held = {}, 0
        if self.spelled > self.most:
            self.pieces.clear()
            self.spelled = 0
        return found

    def batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; none for null."""
        texts = [t or "" for t in texts]
        if not self.by_words:
            return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        parts = [t.replace("\n", " \n").replace(" \n \n", "\n\n").split(" ") for t in texts]
        new = self._new(set().union(*parts))
        # A word with white space at an end, other than one line feed before it, stood next to more white space.
        odd = {w for w in new if not w or w[-1].isspace() or w[0].isspace() and (w[0] != "\n" or w[1].isspace())}
        if odd or any(not p[0] or p[0][0].isspace() for p in parts):
            parts = [p if p[0] and not p[0][0].isspace() and odd.isdisjoint(p) else self._cut(t) for p, t in zip(parts, texts, strict=True)]
            new = self._new(set().union(*(p[1:] for p in parts)))
        heads = [p[0] for p in parts]
        self._learn([w for w in new if w[0] != "\n"], " ")
        self._learn([w for w in new if w[0] == "\n"], "")
        look = self.known.__getitem__
        return [np.frombuffer(self._whole(h) + b"".join(map(look, p[1:])), "<u4") for h, p in zip(heads, parts, strict=True)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The parts of a text with runs of white space."""
        head, *tail = _CUT.split(text)
        return [head, *[x.removeprefix(" ") for x in tail]]


def encoder(path: str, plain: bool = False) -> Encoder:
    if (path, plain) not in _loaded:
        _loaded[path, plain] = Encoder(path, plain=plain)
    return _loaded[path, plain]


def portions(texts: list[str | None], characters: int = 1_000_000) -> Iterable[slice]:
    """Slices of about so many characters, so that what a task holds doesn't grow with the longest texts' number."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= characters:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))

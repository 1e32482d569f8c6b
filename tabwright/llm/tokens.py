"""Token ids of whole texts with a public tokenizer, one library call per word stem that is new to a worker.

A text is cut where every pre-tokenizer in use cuts anyway, at white space, so encoding the pieces one
by one gives the ids of the whole text. Most pieces are Latin letters with punctuation behind them, where
the pre-tokenizers cut once more: such stems go straight to the library's BPE model, all other pieces
through the whole tokenizer. A worker keeps the ids of pieces and stems it has seen; a store is emptied when it
reaches KEPT entries, which changes the time and never the result.

`added` says what the strings of added tokens (like '<|endoftext|>') in a text are: their tokens, as in the
library's plain call, or ordinary text. In the first case a text with such a string goes whole through the library,
because white space before it is grouped otherwise.
"""

from __future__ import annotations

import os
import re

import numpy as np

KEPT = 400_000
AT_ONCE = 1 << 20  # characters that are split at once
#: White_Space of Unicode
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: byte-level: a run of white space gives its last space to the word after it
PIECES = {
    "byte": re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"),
    "word": re.compile(f"[^{WHITE}]+"),
}
LETTERS = "A-Za-z" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
STEM = re.compile(f"( ?[{LETTERS}]+)([-.,!?;:%&#$*|]*)")
_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """`ids(texts)` as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kind: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        marks = self.tokenizer.get_added_tokens_decoder().values() if added else ()
        # a token that is looked for in the normalised text may come from any text
        self.marked = re.compile("|".join("" if t.normalized else re.escape(t.content) for t in marks)).search if marks else None
        self.split, self.lower = PIECES[kind].findall, kind == "word"
        self.pieces: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        # how the byte-level step spells a letter, asked of the tokenizer itself
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = [c for c in map(chr, range(0x100)) if STEM.fullmatch(c)]
        self.spelling = {ord(c): spell(c)[0][0] for c in letters}
        if kind == "byte":
            self.spelling[32] = spell(" a")[0][0][:-1]

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if self.marked(t)] if self.marked else []
        if not whole:
            return self._pieced(texts)
        rest = sorted(set(range(len(texts))).difference(whole))
        out = dict(zip(rest, self._pieced([texts[k] for k in rest]), strict=True))
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return [out[k] for k in range(len(texts))]

    def _pieced(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= AT_ONCE:
                out += self._ids(some)
                some, size = [], 0
        return out + self._ids(some)

    def _ids(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        new = set().union(*pieces).difference(self.pieces)
        if len(self.pieces) + len(new) > KEPT:
            self.pieces.clear()
            new = set().union(*pieces)
        self._learn(new)
        known = self.pieces
        return [b"".join([known[p] for p in own]) for own in pieces]

    def _learn(self, new: set[str]) -> None:
        if len(self.stems) > KEPT:
            self.stems.clear()
        match, stem_of, tokenize = STEM.fullmatch, self._stem, self.tokenizer.model.tokenize
        rest = []
        for piece in new:
            found = match(piece)
            if found is None:
                rest.append(piece)
                continue
            stem, tail = found.groups()
            ids = stem_of(stem)
            self.pieces[piece] = ids + self._tail(tail, tokenize) if tail else ids
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for piece, found in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                self.pieces[piece] = np.array(found.ids, dtype="<u4").tobytes()

    def _stem(self, stem: str) -> bytes:
        ids = self.stems.get(stem)
        if ids is None:
            text = (stem.lower() if self.lower else stem).translate(self.spelling)
            ids = self.stems[stem] = np.array([t.id for t in self.tokenizer.model.tokenize(text)], dtype="<u4").tobytes()
        return ids

    def _tail(self, tail: str, tokenize) -> bytes:
        ids = self.stems.get(tail)
        if ids is None:
            ids = self.stems[tail] = np.array([t.id for t in tokenize(tail)], dtype="<u4").tobytes()
        return ids


def encoder(path: str, kind: str, added: bool = False) -> PieceEncoder:
    """One encoder per worker process, file and meaning of added tokens."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = PieceEncoder(path, kind, added)
    return _ENCODERS[path, added]

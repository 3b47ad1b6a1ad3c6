"""Exact sub-word ids of whole texts, with repeated words encoded once.

A text is cut only where a cut cannot change its ids: before a blank that has a non-blank character on
both sides. Both tokenizer families used here start a new pre-token there, so the ids of a text are the
ids of its pieces in order. Pieces repeat heavily in real corpora, so each Python worker keeps a bounded
table of the pieces it has met; pieces beyond the bound are encoded again each time, never dropped. The texts of a
call are numbered, encoded and gathered together, so that nothing but a table lookup is done for each piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Pieces and ids that a worker remembers, and the longest piece that is worth remembering.
KEEP_PIECES, KEEP_IDS, KEEP_CHARS = 1_000_000, 8_000_000, 48
#: Pieces in one text for the library, and such texts in one library call: a call's results take some 100 bytes a token.
BLOCK, CALL = 50, 100

_CUT = re.compile(r"(?<=\S)(?= \S)")
_RARE_BLANK = re.compile(r"[^\S \n]")
_LOADED: dict[tuple[str, str], "SubwordEncoder"] = {}


def encoder(path: str, kind: str) -> "SubwordEncoder":
    """The worker's encoder for a tokenizer file; kind: 'byte' (blanks count) or 'word' (blanks are dropped)."""
    if (path, kind) not in _LOADED:
        forget()
        _LOADED[path, kind] = SubwordEncoder(path, kind)
    return _LOADED[path, kind]


def forget() -> None:
    """Let go of the worker's encoder and its table."""
    _LOADED.clear()


class _Numbers(dict):
    """Piece to its number. A piece it lacks gets the next number and waits to be encoded."""

    def __init__(self, encoder: "SubwordEncoder", before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, piece: str) -> int:
        fresh = self.encoder.fresh
        self[piece] = number = self.encoder.held + len(fresh)
        fresh.append((self, piece))
        return number


class SubwordEncoder:
    """ids(texts) gives one int32 array for each text, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, kind: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_blanks = kind == "byte"
        #: A mark that is a token of its own between two pieces, so that many pieces share one library call.
        self.mark = "\n" if self.keeps_blanks else "\x01"
        self.joint = "\n" if self.keeps_blanks else " \x01 "
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        #: Pieces as they stand, and pieces that had a blank before them.
        self.whole, self.after_blank = _Numbers(self, ""), _Numbers(self, " ")
        self.fresh: list[tuple[_Numbers, str]] = []
        #: The ids of piece i are flat[ends[i - 1]:ends[i]].
        self.flat, self.size = np.zeros(1 << 16, np.int32), 0
        self.ends, self.held = np.zeros(1 << 16, np.int64), 1
        #: The most pieces that are remembered; ids are the same for any number.
        self.keep_pieces = KEEP_PIECES

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """The pieces, and whether each but the first has lost the blank before it."""
        if self.keeps_blanks and (text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _RARE_BLANK.search(text)):
            return _CUT.split(text), False
        return text.split(" "), self.keeps_blanks

    def _called(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The library's ids of each text, by calls of bounded size."""
        for at in range(0, len(texts), CALL):
            for got in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False):
                yield np.array(got.ids, np.int32)

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        """The library's ids of each piece. Plain pieces go in blocks with the mark between them."""
        out: list = [None] * len(pieces)
        odd, plain = [], []
        for i, p in enumerate(pieces):
            (odd if self.mark in p or "<|" in p or not p or p.isspace() else plain).append(i)
        blocks = [plain[at : at + BLOCK] for at in range(0, len(plain), BLOCK)]
        for block, ids in zip(blocks, self._called([self.joint.join([pieces[i] for i in b]) for b in blocks])):
            marks = np.flatnonzero(ids == self.mark_id[0])
            if len(self.mark_id) != 1 or len(marks) != len(block) - 1:
                odd += block
                continue
            begin = 0
            for i, end in zip(block, [*marks.tolist(), len(ids)]):
                out[i] = ids[begin:end]
                begin = end + 1
        for i, ids in zip(odd, self._called([pieces[i] for i in odd])):
            out[i] = ids
        return out

    def _append(self, ids: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in ids])
        while self.size + n.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held + len(n) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.size : self.size + n.sum()] = np.concatenate(ids)
        self.ends[self.held : self.held + len(n)] = self.size + np.cumsum(n)
        self.held, self.size = self.held + len(n), self.size + int(n.sum())

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        held, size, numbers, bounds, kept = self.held, self.size, [], [0], False
        try:
            for text in texts:
                if text:
                    ps, bare = self.pieces(text)
                    if bare:
                        numbers.append(self.whole[ps[0]])
                        numbers.extend(map(self.after_blank.__getitem__, ps[1:]))
                    else:
                        numbers.extend(map(self.whole.__getitem__, ps))
                bounds.append(len(numbers))
            if self.fresh:
                self._append(self._encode([table.before + p for table, p in self.fresh]))
            at = np.array(numbers, np.int64)
            begin = self.ends[at - 1]
            n = self.ends[at] - begin
            done = np.concatenate([[0], np.cumsum(n)])
            flat = self.flat[np.repeat(begin - done[:-1], n) + np.arange(done[-1])]
            kept = self.held <= self.keep_pieces and self.size <= KEEP_IDS
        finally:  # what there is no room for, and what could not be encoded, is forgotten
            for table, p in self.fresh:
                if not kept or len(p) > KEEP_CHARS:
                    del table[p]
            self.fresh = []
            if not kept:
                self.held, self.size = held, size
        cut = done[bounds].tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

"""Token ids of whole texts by a public tokenizer, with repeated words encoded once.

A text is cut at places where the tokenizer's own splitting always cuts (before white space,
and after a run of letters), so the ids of the pieces in a row are the ids of the text.  Pieces
are numbered in a dictionary of the worker; only new ones go through the tokenizer, many in one
call, and numpy puts the ids of a block of texts together.  Texts with characters for which the
cuts are not certain (special-token strings, control separators) are encoded whole.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from itertools import chain
from unicodedata import is_normalized

import numpy as np

#: Pieces kept by a worker before its dictionary starts anew; bounds memory, not results.
MAX_PIECES = 400_000
#: The same of whole words, whose ids are put together from their pieces' again.
MAX_WORDS = 800_000
#: White space to Python alone, or the start of a special-token string.
UNSURE = re.compile(r"[\x1c-\x1f]|<\|")
_SIGNS = ("<|", *"\x1c\x1d\x1e\x1f")


def unsure(text: str) -> bool:
    """What ``UNSURE`` finds, by searches that are faster on long texts."""
    return any(s in text for s in _SIGNS)


@dataclass(frozen=True)
class Cuts:
    """How texts of one tokenizer file are cut, and a text that parts pieces in one call."""

    pattern: str
    separator: str
    mark: str
    lower: bool = False
    #: No piece holds white space, so texts part there first and a word's pieces are looked for once.
    by_word: bool = False


#: Space goes with the word after it; a line end is a token of its own.
BYTE_LEVEL = Cuts(r" ?[^\W\d_]+(?!\w)| ?\S+|\s+(?!\S)|\s", "\n", "\n")
#: White space is dropped; accents may join the letter before them, so no cut before non-ASCII, nor after İ, which becomes two characters.
WORD_END = Cuts(r"[^\W\d_İ]+(?![^\x00-\x7f]|\w)|\S+", " \x01 ", "\x01", True, True)


class Numbers(dict):
    """piece -> number, in order of first sight."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Store:
    """Ids of numbered pieces, one after the other."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.numbers = Numbers()
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)

    def _add(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the next pieces: where each begins in ``flat``, and how many it has."""
        need = self.used + len(flat)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.empty(max(need, 2 * len(self.flat)) - self.used, np.uint32)])
        self.flat[self.used:need] = flat
        self.starts = np.concatenate([self.starts, self.used + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = need

    def _ids_of(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and their number for each run of ``counts`` pieces."""
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[pieces] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)


def _numbered(cut: list[list[str]], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pieces in a row, and how many each list has."""
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    return np.fromiter(map(numbers.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum())), counts


@dataclass
class Encoder(Store):
    path: str
    cuts: Cuts

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.bare = self.tokenizer
        if self.cuts.lower:
            self.bare = Tokenizer.from_file(self.path)
            self.bare.normalizer = None  # for pieces that it would not change
        self.find = re.compile(self.cuts.pattern).findall
        ids = self._ids([self.cuts.mark])[0]
        self.mark_id = int(ids[0]) if len(ids) == 1 else None
        self._clear()
        self.words = Store()

    def _ids(self, texts: list[str], bare: bool = False) -> list[np.ndarray]:
        tokenizer = self.bare if bare else self.tokenizer
        return [np.asarray(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _settled(self, piece: str) -> bool:
        """The normalizer would leave the piece as it is."""
        return piece == piece.lower() and is_normalized("NFC", piece)

    def _learn(self) -> None:
        """Ids of the new pieces: many in one text, parted by a mark; those that may not be joined, alone."""
        new = self.numbers.new
        if not new:
            return
        alone = [i for i, p in enumerate(new) if self.mark_id is None or self.cuts.mark in p or p.isspace() or UNSURE.search(p)]
        odd = set(alone)
        rest = [i for i in range(len(new)) if i not in odd] if odd else list(range(len(new)))
        easy = [i for i in rest if self._settled(new[i])] if self.cuts.lower else rest
        hard = sorted(set(rest).difference(easy)) if self.cuts.lower else []
        flats, order, sizes = [], [], []
        for some, bare in ((easy, True), (hard, False)):
            groups = [some[k:k + 500] for k in range(0, len(some), 500)]
            for group, got in zip(groups, self._ids([self.cuts.separator.join([new[i] for i in g]) for g in groups], bare)):
                marks = np.flatnonzero(got == self.mark_id)
                if len(marks) != len(group) - 1:
                    alone += group
                    continue
                flats.append(got[got != self.mark_id])
                order += group
                sizes.append(np.diff(marks, prepend=-1, append=len(got)) - 1)
        singles = self._ids([new[i] for i in alone])
        flat = np.concatenate([*flats, *singles])
        sizes = np.concatenate([*sizes, np.fromiter(map(len, singles), np.int64, len(singles))]).astype(np.int64)
        place = np.empty(len(new), np.int64)
        place[order + alone] = np.arange(len(new))
        self._add(flat, (np.cumsum(sizes) - sizes)[place], sizes[place])
        self.numbers.new = []

    def _cut(self, text: str) -> list[str]:
        if unsure(text):
            return [text]
        if self.cuts.lower and (text.isascii() or ("Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", text.lower()))):
            text = text.lower()  # what the tokenizer itself would do next
        return text.split() if self.cuts.by_word else self.find(text)

    def _learn_words(self) -> None:
        """Ids of the new words: those of their pieces in a row."""
        new = self.words.numbers.new
        if not new:
            return
        odd = unsure("\n".join(new))
        ids, sizes = self._encode([[w] if odd and unsure(w) else self.find(w) for w in new])
        self.words._add(ids, np.cumsum(sizes) - sizes, sizes)
        self.words.numbers.new = []

    def _encode(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > MAX_PIECES:
            self._clear()
        pieces, counts = _numbered(cut, self.numbers)
        self._learn()
        return self._ids_of(pieces, counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the number of ids of each text."""
        cut = [self._cut(t) for t in texts]
        if not self.cuts.by_word:
            return self._encode(cut)
        if len(self.words.numbers) > MAX_WORDS:
            self.words._clear()
        words, counts = _numbered(cut, self.words.numbers)
        self._learn_words()
        return self.words._ids_of(words, counts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cuts: Cuts) -> Encoder:
    """The worker's encoder for a file; its dictionary lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cuts)
    return _ENCODERS[path]


def end_each(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after the ids of each text."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end_id)).astype(np.uint32, copy=False), counts + 1

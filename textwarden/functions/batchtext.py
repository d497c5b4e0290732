"""Normalization, readings and words of many texts at once, as one array of code points.

Texts stand one after the other, END after each. What ``rowtext`` does to one text is done here by a few
passes over the array, slices of SLICE characters at a time, which the processor's cache holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import regex

from textwarden.functions import charsets as C
from textwarden.functions import rowtext
from textwarden.functions.steps import COMPARISON, character_table

#: A noncharacter; texts that hold it go through ``rowtext`` one by one.
END = 0x10FFFF
END_TEXT = chr(END)
SLICE = 1 << 16
ALL = 0x110000
GONE = rowtext.Characters.GONE
SPACE = 32
BOUNDARY, LETTER, DIGIT, WORD, PLAIN_LETTER, SOLID = 1, 2, 4, 8, 16, 32
JOINERS = np.array([0x200C, 0x200D], np.uint32)


@cache
def flags() -> np.ndarray:
    """What each character is, as bits: ends a run, a letter or enclosed letter, a digit that may be a letter, part of a word, a letter of the basic plane, a letter or decimal digit of it."""
    out = np.zeros(ALL, np.uint8)
    out[rowtext.codes(C.members(C.is_boundary))] |= BOUNDARY
    out[END] = BOUNDARY
    out[rowtext.codes(C.members(C.is_letter))] |= LETTER | PLAIN_LETTER
    out[rowtext.codes(C.members(C.is_letter_or_digit))] |= SOLID
    out[rowtext.codes("".join(C.enclosed_table()))] |= LETTER
    out[rowtext.codes("".join(C.DIGIT_LETTERS))] |= DIGIT
    out[:0x10000][rowtext._word_characters()] |= WORD
    for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", "".join(map(chr, range(0x10000, ALL)))):
        out[0x10000 + m.start() : 0x10000 + m.end()] |= WORD
    return out


@cache
def _table(steps: frozenset[str]) -> np.ndarray:
    """What becomes of each character; white space is a space where runs of it collapse."""
    out = np.arange(ALL, dtype=np.uint32)
    out[:0x10000] = rowtext.Characters(character_table(steps)).codes
    if "collapseWhitespace" in steps:
        out[rowtext.BLANKS] = SPACE
    return out


@cache
def _fold_table() -> np.ndarray:
    out = np.full(ALL, GONE, np.uint32)
    out[:0x10000] = rowtext._fold_table().codes[:0x10000]
    for c, to in C.enclosed_table().items():
        out[ord(c)] = ord(to)
    out[END] = END
    return out


@cache
def _digit_table() -> np.ndarray:
    out = np.arange(128, dtype=np.uint32)
    for c, to in C.DIGIT_LETTERS.items():
        out[ord(c)] = ord(to)
    return out


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of SLICE characters together, or of one text."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield start, k
            start, size = k, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[str]) -> np.ndarray:
    return np.frombuffer((END_TEXT.join(texts) + END_TEXT).encode("utf-32-le", "surrogatepass"), np.uint32)


def apart(chars: np.ndarray) -> list[str]:
    return chars.tobytes().decode("utf-32-le", "surrogatepass").split(END_TEXT)[:-1]


def normalized(chars: np.ndarray, steps: frozenset[str] = COMPARISON) -> np.ndarray:
    """The steps but NFKC."""
    out = _table(steps).take(chars)
    gone = out == GONE
    if gone.any():
        out = out[~gone]
    if "collapseRepeats" in steps:
        keep = rowtext.short_runs(out)
        if not keep.all():
            out = out[keep]
    if "collapseWhitespace" in steps:
        drop = out == SPACE
        after = np.ones(len(out), bool)  # a space or the end of a text stands before
        np.logical_or(drop[:-1], out[:-1] == END, out=after[1:])
        drop &= after
        if drop.any():
            out = out[~drop]
        ends = np.flatnonzero(out == END)
        last = ends[out[ends - 1] == SPACE] - 1
        if len(last):
            out = np.delete(out, last)
    return out


def squeezed(chars: np.ndarray) -> np.ndarray:
    keep = rowtext.single_runs(chars)
    nul = np.flatnonzero(chars == 0)
    if len(nul):
        keep[nul[(nul == 0) | (chars[nul - 1] == END)]] = False
    return chars if keep.all() else chars[keep]


def folded(chars: np.ndarray) -> np.ndarray:
    kind = flags().take(chars)
    digits = np.flatnonzero(kind & DIGIT)
    if len(digits):
        # letters seen up to each run's ends tell whether a digit's run has one
        ends = np.flatnonzero(kind & BOUNDARY)
        letters = np.concatenate([[0], np.cumsum((kind & LETTER) != 0)])
        run = np.searchsorted(ends, digits)
        read = digits[letters[ends[run]] > letters[np.where(run > 0, ends[run - 1], 0)]]
        chars = chars.copy()
        chars[read] = _digit_table()[chars[read]]
    out = _fold_table().take(chars)
    gone = out == GONE
    return out[~gone] if gone.any() else out


def _inside(chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which characters are part of a word."""
    inside = (kind & WORD) != 0
    joiners = np.flatnonzero((chars & ~np.uint32(1)) == JOINERS[0])
    if len(joiners):
        inside[joiners[(joiners > 0) & ((kind[joiners - 1] & PLAIN_LETTER) != 0)]] = True
    return inside


def words(chars: np.ndarray) -> list[list[str]]:
    """The maximal runs of word characters of each text."""
    inside = _inside(chars, flags().take(chars)) | (chars == END)
    return [t.split() for t in apart(np.where(inside, chars, np.uint32(SPACE)))]


BASE, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2 to the 64."""
    out = []
    for base in (BASE, INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def text_hash(text: str) -> int:
    """The hash that a run of these characters has; that of a + b is that of a, and b's times BASE to a's length."""
    out = 0
    for c in reversed(text):
        out = (out * BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return out


class Table:
    """Hashes as bits of a table: tells most that are not of a kind; no false no."""

    def __init__(self, kinds: dict[int, Iterable[str]]):
        kinds = {bit: {*texts} for bit, texts in kinds.items()}
        size = max(16, (32 * sum(map(len, kinds.values()))).bit_length())
        self.shift, self.bits = np.uint64(64 - size), np.zeros(1 << size, np.uint8)
        for bit, texts in kinds.items():
            if texts:
                self.bits[self.slots(np.array([text_hash(t) for t in texts], np.uint64))] |= bit

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * SPREAD) >> self.shift).view(np.int64)

    def has(self, hashes: np.ndarray, bit: int) -> np.ndarray:
        return (self.bits.take(self.slots(hashes)) & bit) != 0


WORDS, PAIRS, HEADS = 1, 2, 4
#: (number, start, end) of a chunk.
Piece = tuple[int, int, int]


def broken_chunks(chars: np.ndarray) -> list[list[Piece]]:
    """Of each normalized text what stands between spaces and has letters or digits on both sides of something else."""
    solid = (flags().take(chars) & SOLID) != 0
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edges = np.concatenate([[0], edges])
    breaks = np.flatnonzero((chars == SPACE) | (chars == END))
    first, last = np.searchsorted(breaks, edges[0::2]), np.searchsorted(breaks, edges[1::2])
    chunks = np.unique(first[1:][first[1:] == last[:-1]])  # one run of solid characters ends in the chunk in which the next begins
    stops = np.flatnonzero(chars[breaks] == END)
    begins = np.concatenate([[-1], breaks])[chunks] + 1
    out, a, number, origin = [], 0, 0, 0
    numbers, begins, ends, parts = chunks.tolist(), begins.tolist(), breaks[chunks].tolist(), np.searchsorted(chunks, stops, "right").tolist()
    for stop, b in zip(stops.tolist(), parts):
        out.append([(numbers[k] - number, begins[k] - origin, ends[k] - origin) for k in range(a, b)])
        a, number, origin = b, stop + 1, int(breaks[stop]) + 1
    return out


class Words:
    """The words of one reading: where they are, and which may hold something or join with the next."""


    __slots__ = ("text", "starts", "ends", "hot", "pairs", "_names")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, hot: list[int], pairs: list[int]):
        self.text, self.starts, self.ends, self.hot, self.pairs, self._names = text, starts, ends, hot, pairs, None

    @property
    def names(self) -> list[str]:
        if self._names is None:
            text = self.text
            self._names = [text[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]
        return self._names

    def name(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, at: int | slice) -> str | list[str]:
        return self.name(at) if isinstance(at, int) else [self.name(i) for i in range(*at.indices(len(self.starts)))]


def placed_words(chars: np.ndarray, texts: list[str], table: Table, least: int) -> list[Words]:
    """The words of each text; least is the length of the table's heads, 0 for none."""
    kind = flags().take(chars)
    inside = _inside(chars, kind)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    size = 1 << max(17, len(chars).bit_length())
    powers, inverse = _powers(size)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars + np.uint32(1)) * powers[: len(chars)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    lengths = ends - starts
    hot = table.has(hashes, WORDS) | ((lengths == 1) & ((kind[starts] & PLAIN_LETTER) != 0))
    if least and len(chars) > least:
        at = np.flatnonzero(table.has((sums[least:] - sums[:-least]) * inverse[: len(chars) + 1 - least], HEADS))
        word = np.searchsorted(ends, at, "right")
        fits = word < len(ends)
        at, word = at[fits], word[fits]
        hot[word[(at >= starts[word]) & (at + least <= ends[word])]] = True
    stops = np.flatnonzero(chars == END)
    last = np.searchsorted(starts, stops)
    pairs = np.zeros(len(starts), bool)
    if len(starts) > 1:
        pairs[:-1] = table.has(hashes[:-1] + hashes[1:] * powers[lengths[:-1]], PAIRS)
        pairs[last[last > 0] - 1] = False  # the last of a text has no next
    hot_at, pair_at = np.flatnonzero(hot), np.flatnonzero(pairs)
    hot_last, pair_last = np.searchsorted(hot_at, last).tolist(), np.searchsorted(pair_at, last).tolist()
    out, a, h, p, origin = [], 0, 0, 0, 0
    for k, b in enumerate(last.tolist()):
        hl, pl = hot_last[k], pair_last[k]
        out.append(Words(texts[k], starts[a:b] - origin, ends[a:b] - origin, (hot_at[h:hl] - a).tolist(), (pair_at[p:pl] - a).tolist()))
        a, h, p, origin = b, hl, pl, int(stops[k]) + 1
    return out


def each(texts: Iterable[str | None], many: Callable[[np.ndarray], list], one: Callable[[str], object]) -> list:
    """What many makes of slices of the texts; one, of a text that holds END. None counts as empty."""
    texts = [t or "" for t in texts]
    out: list = []
    for a, b in slices(texts):
        part = texts[a:b]
        odd = [k for k, t in enumerate(part) if not t.isascii() and END_TEXT in t]
        made = many(joined(["" if END_TEXT in t else t for t in part] if odd else part))
        for k in odd:
            made[k] = one(part[k])
        out += made
    return out

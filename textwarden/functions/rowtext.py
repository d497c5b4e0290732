"""The same normalization, tokens and readings for one text, with the place each character came from.

A ``Traced`` text carries, for each of its characters, the first and last place in the message that
it stands for. The two differ only where piecewise NFKC disagrees with NFKC of the whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import regex

from textwarden.functions import charsets as C
from textwarden.functions.steps import COMPARISON, character_table, resolve

WORD_PART = r"(?:[\p{L}\p{M}\p{N}]|(?<=[[\p{L}]&&[\u0000-￿]])[‌‍])"
WORD = regex.compile(WORD_PART + "+", regex.V1)
PART = regex.compile(WORD_PART, regex.V1)
JOINERS = regex.compile("[\u200c\u200d]")
#: Every ASCII character but letters and digits becomes a space.
ASCII_WORDS = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))
BLANKS = np.array(sorted(map(ord, C.WHITE_SPACE)), np.uint32)
SEGMENT = regex.compile(r".\p{M}*", regex.DOTALL)


class Characters:
    """A replacement of single characters of the basic plane; '' removes one."""

    GONE = 0xFFFFFFFF

    def __init__(self, table: dict[str, str]):
        self.table = {ord(c): to or None for c, to in table.items()}
        self.codes = np.arange(0x10000, dtype=np.uint32)
        for c, to in table.items():
            if C.is_bmp(c):
                self.codes[ord(c)] = ord(to) if to else self.GONE

    def __call__(self, text: str) -> str:
        if text.isascii() or max(text) > "\uffff":
            return text.translate(self.table)
        out = self.codes[codes(text)]
        return out[out != self.GONE].tobytes().decode("utf-32-le", "surrogatepass")

    def kept(self, text: str) -> np.ndarray:
        """Which characters of a text have a counterpart."""
        chars = codes(text)
        return self.codes[np.minimum(chars, 0xFFFF)] != self.GONE


@cache
def _table(steps: frozenset[str]) -> Characters:
    return Characters(character_table(steps))


@cache
def _blanks() -> Characters:
    return Characters(dict.fromkeys(C.WHITE_SPACE, " "))


def one_space(text: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return " ".join([w for w in _blanks()(text).split(" ") if w])


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def picked(text: str, keep: np.ndarray) -> str:
    """The kept characters of a text."""
    return text if keep.all() else codes(text)[keep].tobytes().decode("utf-32-le", "surrogatepass")


def short_runs(chars: np.ndarray) -> np.ndarray:
    """What is kept where runs of a character of the basic plane, but blanks, go down to two."""
    keep = np.ones(len(chars), bool)
    same = chars[1:] == chars[:-1]
    third = np.flatnonzero(same[1:] & same[:-1]) + 2
    keep[third] = np.isin(chars[third], BLANKS) | (chars[third] > 0xFFFF)
    return keep


def single_runs(chars: np.ndarray) -> np.ndarray:
    """What is kept where runs of a character of the basic plane, but spaces, go down to one; leading U+0000 goes."""
    keep = np.ones(len(chars), bool)
    keep[:1] = chars[:1] != 0
    keep[1:] = (chars[1:] != chars[:-1]) | (chars[1:] == 32) | (chars[1:] > 0xFFFF)
    return keep


def normalize(text: str | None, steps: str | Iterable[str] = "comparison") -> str:
    chosen = steps if isinstance(steps, frozenset) else resolve(steps)
    out = text or ""
    if "compatibilityForms" in chosen and not out.isascii():
        out = unicodedata.normalize("NFKC", out)
    out = _table(chosen)(out)
    if "collapseRepeats" in chosen:
        out = picked(out, short_runs(codes(out)))
    if "collapseWhitespace" in chosen:
        out = one_space(out)
    return out


@cache
def _word_characters() -> np.ndarray:
    """Whether each character of the basic plane is one of a word by itself."""
    out = np.zeros(0x10000, bool)
    out[codes("".join(regex.findall(r"[\p{L}\p{M}\p{N}]", "".join(map(chr, range(0x10000))))))] = True
    return out


def words(text: str) -> list[str]:
    """The maximal runs of word characters."""
    if text.isascii():
        return text.translate(ASCII_WORDS).split()
    chars = codes(text)
    if chars.max() > 0xFFFF or JOINERS.search(text):
        return WORD.findall(text)
    return np.where(_word_characters()[chars], chars, 32).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split()


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the maximal runs of word characters."""
    out, end = [], 0
    for word in words(text):
        start = text.find(word, end)  # between words no character is one of a word
        end = start + len(word)
        out.append((word, start, end))
    return out


def to_persian_digits(text: str | None) -> str:
    return (text or "").translate(str.maketrans(C.ASCII_DIGITS, C.PERSIAN_DIGITS))


def to_ascii_digits(text: str | None) -> str:
    return normalize(text, frozenset(["asciiDigits"]))


def squeeze(text: str) -> str:
    return picked(text, single_runs(codes(text)))


BEYOND = regex.compile("[\U00010000-\U0010FFFF]")
DIGITS = regex.compile(f"[{''.join(C.DIGIT_LETTERS)}]")


@cache
def _fold_table() -> Characters:
    """What becomes of each character of the basic plane but digits, and of enclosed letters."""
    return Characters(dict.fromkeys(C.members(C.is_filler), "") | C.folded_letters() | C.enclosed_table())


@cache
def _digit_run() -> tuple[regex.Pattern, regex.Pattern, dict[int, str]]:
    """Runs with a digit that may be a letter, the test for a letter, and the digits' letters."""
    ends, digits = C.python_class(C.members(C.is_boundary)), "".join(C.DIGIT_LETTERS)
    run = regex.compile(rf"(?<![^{ends}])[^{ends}{digits}]*+[{digits}][^{ends}]*")
    letter = regex.compile(rf"[[\p{{L}}]&&[\u0000-￿]]|[{''.join(C.enclosed_table())}]", regex.V1)
    return run, letter, str.maketrans(C.DIGIT_LETTERS)


def fold(text: str) -> str:
    """Look-alikes as their letters, filler dropped; digits only in runs with a letter.

    Filler never ends a run and no letter's table touches what does, so all but digits works on the whole text.
    """
    if DIGITS.search(text):
        run, letter, letters = _digit_run()
        text = run.sub(lambda m: m[0].translate(letters) if letter.search(m[0]) else m[0], text)
    if not text.isascii() and max(text) > "\uffff":
        text = BEYOND.sub(lambda m: C.enclosed_table().get(m[0], ""), text)
    return _fold_table()(text)


@dataclass(frozen=True)
class Traced:
    text: str
    first: np.ndarray
    last: np.ndarray

    def cut(self, text: str, keep: np.ndarray) -> Traced:
        """The text that is left of this one with what is kept."""
        if len(text) == len(self.text):
            return Traced(text, self.first, self.last)
        return Traced(text, self.first[keep], self.last[keep])

    def squeezed(self) -> Traced:
        return self.cut(squeeze(self.text), single_runs(codes(self.text)))

    def folded(self) -> Traced:
        text = fold(self.text)
        if len(text) == len(self.text):
            return Traced(text, self.first, self.last)
        enclosed = C.enclosed_table()
        return self.cut(text, _fold_table().kept(self.text) & np.array([C.is_bmp(c) or c in enclosed for c in self.text]))


def traced(message: str) -> Traced:
    """The comparison form of a message with its places."""
    whole = normalize(message, COMPARISON)
    text, places = message, np.arange(len(message))
    if not (message.isascii() or unicodedata.is_normalized("NFKC", message)):
        pieces = [(unicodedata.normalize("NFKC", m[0]), m.start()) for m in SEGMENT.finditer(message)]
        text, places = "".join([t for t, _ in pieces]), np.array([i for t, i in pieces for _ in t], np.int64)
    if not text.isascii():
        places = places[_table(COMPARISON).kept(text)]
    text = _table(COMPARISON)(text)
    keep = short_runs(codes(text))
    text, places = picked(text, keep), places[keep]
    # of a run of white space its last character stands for it
    blank = np.isin(codes(text), BLANKS)
    solid = np.flatnonzero(~blank)
    keep = ~blank
    keep[:-1] |= blank[:-1] & ~blank[1:]
    keep[: solid[0] if len(solid) else len(keep)] = False
    places, text = places[keep], one_space(text)
    return Traced(text, places, places) if text == whole else _by_chunks(message, whole)


def _by_chunks(message: str, text: str) -> Traced:
    """Each piece between blanks stands for the piece of the message in its place, or all for all."""
    solid = regex.compile(f"[^{C.WHITE_SPACE}]+")
    theirs = [(m.start(), m.end() - 1) for m in solid.finditer(message)]
    ours = [(m.start(), m.end()) for m in solid.finditer(text)]
    if len(theirs) != len(ours):
        return Traced(text, np.zeros(len(text), int), np.full(len(text), max(0, len(message) - 1)))
    first, last = np.zeros(len(text), int), np.zeros(len(text), int)
    for k, ((a, b), (start, end)) in enumerate(zip(ours, theirs)):
        until = ours[k + 1][0] if k + 1 < len(ours) else len(text)
        first[a:until] = start
        last[a:until] = end
    return Traced(text, first, last)

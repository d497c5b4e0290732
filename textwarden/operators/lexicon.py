"""Lexicon compilation: entries and options become lookup tables for both matching paths.

Persian suffixes are worked into the table: each surface form that a key may take is a row of its
own, so a token is found by equality. The tables are made once on the driver, from a word list, whose
size bounds them; ``tables`` gives them as DataFrames for joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from textwarden.functions import charsets as C
from textwarden.functions import rowtext
from textwarden.schemas import BannedWord, GuardOptions

LEAST_MASKABLE = 4


def stem_is_long_enough(stem: str, suffix: str) -> bool:
    return C.units(stem) >= (4 if len(suffix) == 1 else 3)


def surfaces(key: str) -> list[tuple[int, str]]:
    """(rank, surface) of a key: itself, and with each suffix; a smaller rank is tried earlier."""
    out = [(-1, key)]
    if key and C.is_persian_letter(key[0]):
        for k, suffix in enumerate(C.PERSIAN_SUFFIXES):
            if stem_is_long_enough(key, suffix):
                out.append((2 * k, key + suffix))
            stem = key[:-1]
            if key.endswith(C.HEH) and suffix.startswith(C.HEH_SUFFIX_START) and stem and C.is_persian_letter(stem[0]) and stem_is_long_enough(stem, suffix):
                out.append((2 * k + 1, stem + suffix))
    return out


@dataclass
class Lexicon:
    """Compiled entries. Numbers are positions in the list of entries, which also order ties."""

    entries: list[BannedWord]
    options: GuardOptions
    words: dict[str, int] = field(default_factory=dict)
    surface: dict[str, int] = field(default_factory=dict)
    phrases: list[tuple[tuple[str, ...], int]] = field(default_factory=list)
    anywhere: dict[str, int] = field(default_factory=dict)
    maskable: list[tuple[str, bool, int]] = field(default_factory=list)
    count: int = 0

    def __post_init__(self):
        added: set[int] = set()
        seen: set[tuple[str, str]] = set()
        for order, entry in enumerate(self.entries):
            norm = rowtext.normalize(entry.text)
            if not norm or (entry.mode, norm) in seen:
                continue
            seen.add((entry.mode, norm))
            for key in dict.fromkeys([norm, rowtext.fold(norm)] if self.options.fold_lookalike_characters else [norm]):
                if self._add(key, entry.mode, order):
                    added.add(order)
        self.count = len(added)
        ranked: dict[str, tuple[int, int]] = {}
        for key, order in self.words.items():
            for rank, form in surfaces(key):
                if form not in ranked or rank < ranked[form][0]:
                    ranked[form] = (rank, order)
        self.surface = {form: order for form, (_, order) in ranked.items()}
        self.whole = frozenset([*self.words, *self.anywhere])
        self.starts: dict[str, list[tuple[tuple[str, ...], frozenset[str], int]]] = {}
        for words, order in self.phrases:
            last = frozenset(form for rank, form in surfaces(words[-1]) if rank < 0 or rank % 2 == 0)
            self.starts.setdefault(words[0], []).append((words[1:-1], last, order))
        self.masks_by_length: dict[int, list[tuple[str, int, int]]] = {}
        for at, (key, whole, order) in enumerate(self.maskable):
            if whole:
                self.masks_by_length.setdefault(len(key), []).append((key, order, at))
        # overlapping windows in which each character is the key's or a mask (U+0000)
        self.masks_anywhere = [(re.compile("(?=(" + "".join(f"[{re.escape(c)}\0]" for c in key) + "))"), len(key), order, at) for at, (key, whole, order) in enumerate(self.maskable) if not whole]

    @cached_property
    def finder(self):
        """What this process has looked at so far; it does not travel."""
        from textwarden.operators.wordfind import Finder

        return Finder(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finder"}

    def _add(self, key: str, mode: str, order: int) -> bool:
        long = C.units(key) >= LEAST_MASKABLE
        if mode == "anywhere":
            if not key or key in self.anywhere:
                return False
            self.anywhere[key] = order
            if long and " " not in key:
                self.maskable.append((key, False, order))
            return True
        words = [t for t, _, _ in rowtext.tokens(key)]
        if not words:
            return False
        if len(words) > 1:
            self.phrases.append((tuple(words), order))
            return True
        if words[0] in self.words:
            return False
        self.words[words[0]] = order
        if C.units(words[0]) >= LEAST_MASKABLE:
            self.maskable.append((words[0], True, order))
        return True

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """words, surfaces, phrases, anywhere, maskable and entries as DataFrames for joins."""
        grams = [(" ".join([*words[:-1], form]), len(words), order) for words, order in self.phrases for rank, form in surfaces(words[-1]) if rank < 0 or rank % 2 == 0]
        make = spark.createDataFrame
        return {
            "entries": make([(k, e.text, e.mode, e.category) for k, e in enumerate(self.entries)], "entry_order int, text string, mode string, category string"),
            "words": make(list(self.words.items()), "key string, entry_order int"),
            "surfaces": make(list(self.surface.items()), "key string, entry_order int"),
            "phrases": make(grams, "key string, n int, entry_order int"),
            "anywhere": make([(k, len(k), o) for k, o in self.anywhere.items()], "key string, n int, entry_order int"),
            "maskable": make([(k, len(k), w, o) for k, w, o in self.maskable], "key string, n int, whole boolean, entry_order int"),
        }


def compile_lexicon(words: Iterable[BannedWord], options: GuardOptions | None = None) -> Lexicon:
    if words is None or isinstance(words, (str, bytes)):
        raise TypeError("words must be a collection of BannedWord")
    try:
        entries = list(words)
    except TypeError:
        raise TypeError("words must be a collection of BannedWord") from None
    for k, e in enumerate(entries):
        if not isinstance(e, BannedWord):
            raise TypeError(f"words[{k}] must be a BannedWord, not {type(e).__name__}")
    if options is not None and not isinstance(options, GuardOptions):
        raise TypeError("options must be GuardOptions")
    return Lexicon(entries, options or GuardOptions())

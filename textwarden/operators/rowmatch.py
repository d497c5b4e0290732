"""Exact matching of one message: hits by reading, mapped to the message, merged, censored.

Used inside Arrow batches where original positions or the censoring fixpoint are wanted, and on
streams. Hits come from generators in the order of preference, so the first is the least evasion, and
asking for one stops the work.
"""

from __future__ import annotations

import codecs
import threading
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

from textwarden.functions import charsets as C
from textwarden.functions import rowtext
from textwarden.functions.batchtext import Words
from textwarden.operators import wordfind
from textwarden.operators.lexicon import Lexicon
from textwarden.schemas import evasion_names

REPEATED, LOOKALIKE, SPLIT = 1, 2, 4
MASK_LENGTH = 4


@dataclass(frozen=True)
class Hit:
    reading: int
    start: int
    end: int
    order: int
    evasion: int


@dataclass(frozen=True)
class Region:
    order: int
    evasion: int
    start: int
    end: int


class Message:
    """One text under one lexicon."""

    def __init__(self, lexicon: Lexicon, text: str, reads: list[wordfind.Reading] | None = None):
        self.lexicon, self.text = lexicon, text
        self.reads = lexicon.finder.readings([text])[0] if reads is None else reads

    def hits(self) -> Iterator[Hit]:
        if not self.lexicon.count or not self.reads:
            return
        lexicon, options, finder = self.lexicon, self.lexicon.options, self.lexicon.finder
        finder.rest()
        for number, text, words, _ in self.reads:
            # places are for words that may hold something, which are few
            hot = finder.held_in(words)
            for start, end, order in self.in_tokens(words, words.starts, words.ends, hot):
                yield Hit(number, start, end, order, number)
            for start, end, order in self.anywhere(text, words.starts, hot):
                yield Hit(number, start, end, order, number)
            if options.join_spaced_letters:
                if runs := wordfind.letter_runs(hot):
                    parts, firsts, lasts, places = joined_letters(words, runs)
                    parts_hot = finder.held_in_parts(hot, runs, parts)
                    for start, end, order in self.in_tokens(parts, firsts, lasts, parts_hot):
                        yield Hit(number, start, end, order, number | SPLIT)
                    for start, end, order in self.anywhere(" ".join(parts), wordfind.starts(parts), parts_hot):
                        yield Hit(number, places(start), places(end - 1) + 1, order, number | SPLIT)
                for i in wordfind.halves(lexicon, words):
                    for orders in (lexicon.words, lexicon.anywhere):
                        if (order := orders.get(words.name(i) + words.name(i + 1))) is not None:
                            yield Hit(number, int(words.starts[i]), int(words.ends[i + 1]), order, number | SPLIT)
        yield from self.broken_chunks()

    def in_tokens(self, names: list[str] | Words, firsts, lasts, hot: list[tuple[int, wordfind.Held]]) -> Iterator[tuple[int, int, int]]:
        """Words, with suffixes, and phrases."""
        for i, held in hot:
            if held.order is not None:
                yield int(firsts[i]), int(lasts[i]), held.order
            if held.starts:
                for middle, last, number in self.lexicon.starts[names[i]]:
                    j = i + 1 + len(middle)
                    if j < len(names) and names[j] in last and all(names[i + 1 + k] == m for k, m in enumerate(middle)):
                        yield int(firsts[i]), int(lasts[j]), number

    def anywhere(self, text: str, starts, hot: list[tuple[int, wordfind.Held]]) -> Iterator[tuple[int, int, int]]:
        """Every occurrence of every anywhere key, overlapping ones too."""
        finder = self.lexicon.finder
        for n, at in finder.anywhere(text, starts, hot):
            yield at, at + len(finder.keys[n]), self.lexicon.anywhere[finder.keys[n]]

    def broken_chunks(self) -> Iterator[Hit]:
        """Chunks with symbols inside, the symbols taken out or standing for letters."""
        options = self.lexicon.options
        if not (options.join_spaced_letters or options.fold_lookalike_characters):
            return
        for _, first, chunk in self.lexicon.finder.chunks(self.reads):
            start, end = first + chunk.start, first + chunk.end
            if chunk.bare_order is not None:
                yield Hit(0, start, end, chunk.bare_order, SPLIT)
            for k in chunk.masks:
                yield Hit(0, start, end, self.lexicon.maskable[k][2], LOOKALIKE)

    # ---- the message's own places

    @cached_property
    def traces(self) -> dict[int, rowtext.Traced]:
        return {0: rowtext.traced(self.text)}

    def trace(self, reading: int) -> rowtext.Traced:
        if reading not in self.traces:
            self.traces[reading] = {1: lambda: self.trace(0).squeezed(), 2: lambda: self.trace(0).folded(), 3: lambda: self.trace(2).squeezed()}[reading]()
        return self.traces[reading]

    def placed(self, hit: Hit) -> tuple[int, int, int]:
        """(start, end, length before widening) of a hit in the message, widened to whole words."""
        trace = self.trace(hit.reading)
        start, end = int(trace.first[hit.start]), int(trace.last[hit.end - 1]) + 1
        length = C.units(self.text[start:end])
        while start > 0 and rowtext.PART.match(self.text, start - 1):
            start -= 1
        rest = rowtext.WORD.match(self.text, end)
        return start, rest.end() if rest else end, length

    def first(self) -> Region | None:
        hit = next(self.hits(), None)
        if hit is None:
            return None
        start, end, _ = self.placed(hit)
        return Region(hit.order, hit.evasion, start, end)

    def regions(self) -> list[Region]:
        """Overlapping hits merged, in order; the entry is that of the longest hit, earlier ones first."""
        placed = sorted([(*self.placed(h), h) for h in self.hits()], key=lambda p: (p[0], -p[1]))
        out: list[Region] = []
        cluster: list[tuple[int, int, int, Hit]] = []
        reach = -1
        for p in placed:
            if cluster and p[0] >= reach:
                out.append(self.united(cluster))
                cluster, reach = [], -1
            cluster.append(p)
            reach = max(reach, p[1])
        if cluster:
            out.append(self.united(cluster))
        return out

    def united(self, cluster: list[tuple[int, int, int, Hit]]) -> Region:
        best = max(cluster, key=lambda p: (p[2], -p[3].order))[3]
        word = self.lexicon.entries[best.order]
        evasion = min(p[3].evasion for p in cluster if self.lexicon.entries[p[3].order] == word)
        return Region(best.order, evasion, cluster[0][0], max(p[1] for p in cluster))


def joined_letters(words: Words, runs: list[tuple[int, int]]) -> tuple[list[str], list[int], list[int], Callable[[int], int]]:
    """The words with runs of single letters made one, where they start and end, and the place of each character of their line."""
    parts = wordfind.with_runs_joined(words.names, runs)
    starts, ends = words.starts.tolist(), words.ends.tolist()
    firsts, lasts, inner, at = [], [], {}, 0
    for a, b in [*runs, (len(starts), len(starts))]:
        firsts += starts[at:a]
        lasts += ends[at:a]
        if a < b:
            inner[len(firsts)] = starts[a:b]
            firsts.append(starts[a])
            lasts.append(ends[b - 1])
        at = b
    line = wordfind.starts(parts)

    def place(at: int) -> int:
        k = bisect_right(line, at) - 1
        within = at - line[k]
        if within >= len(parts[k]):  # a space is where the word before it ends
            within = len(parts[k]) - 1
        return inner[k][within] if k in inner else firsts[k] + within

    return parts, firsts, lasts, place


# ---- what the public functions return


def blank(text: str | None) -> bool:
    return not text or not text.strip(C.WHITE_SPACE)


def contains(lexicon: Lexicon, text: str | None, reads: list[wordfind.Reading] | None = None) -> bool:
    """Here and below reads are the text's readings, where they were made already, with those of other texts."""
    return not blank(text) and next(Message(lexicon, text, reads).hits(), None) is not None


def as_match(lexicon: Lexicon, region: Region) -> dict:
    entry = lexicon.entries[region.order]
    return {"text": entry.text, "mode": entry.mode, "category": entry.category, "evasion": evasion_names(region.evasion), "index": region.start, "length": region.end - region.start}


def first_match(lexicon: Lexicon, text: str | None, reads: list[wordfind.Reading] | None = None) -> dict | None:
    region = None if blank(text) else Message(lexicon, text, reads).first()
    return region and as_match(lexicon, region)


def matches(lexicon: Lexicon, text: str | None, reads: list[wordfind.Reading] | None = None) -> list[dict]:
    return [] if blank(text) else [as_match(lexicon, r) for r in Message(lexicon, text, reads).regions()]


def validate_mask(mask: object) -> str:
    if not isinstance(mask, str):
        raise TypeError(f"mask must be a string of one character, not {type(mask).__name__}")
    if len(mask) != 1 or not C.is_bmp(mask) or C.is_letter_or_digit(mask) or mask in C.WHITE_SPACE or C.category(mask) in ("Cc", "Cs"):
        raise ValueError("mask must be one character that is no letter, digit, white space or control character")
    return mask


def spliced(text: str, regions: list[Region], mask: str) -> str:
    cuts = [0, *[x for r in regions for x in (r.start, r.end)], len(text)]
    return mask.join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def censor(lexicon: Lexicon, text: str | None, mask: str = "*") -> str:
    return censored(lexicon, [text], mask)[0]


def censored(lexicon: Lexicon, texts: list[str | None], mask: str = "*") -> list[str]:
    """Each region becomes four mask characters, again until nothing is found.

    A round takes letters away, so rounds end; should they not within a round a word, all is masked.
    A round reads those texts together in which the one before found something.
    """
    blot = validate_mask(mask) * MASK_LENGTH
    out = [t or "" for t in texts]
    left: dict[int, int] = {}
    live = [k for k, t in enumerate(out) if not blank(t)]
    while live:
        dirty = []
        for k, reads in zip(live, lexicon.finder.readings([out[k] for k in live])):
            if regions := Message(lexicon, out[k], reads).regions():
                left[k] = left.get(k, len(rowtext.words(out[k])) + 2) - 1
                if left[k] < 0:
                    out[k] = blot
                else:
                    out[k] = spliced(out[k], regions, blot)
                    dirty.append(k)
        live = [k for k in dirty if not blank(out[k])]
    return out


# ---- byte messages: invalid UTF-8 is read as U+FFFD and returned as it was


_decoding = threading.local()


def _mark(error: UnicodeDecodeError) -> tuple[str, int]:
    _decoding.broken[error.start] = error.end
    return "\ufffd", error.end


codecs.register_error("textwarden-mark", _mark)


def decoded(data: bytes) -> tuple[str, list[int]]:
    """The text, and the byte at which each character starts, with the end last."""
    _decoding.broken = broken = {}
    text = bytes(data).decode(errors="textwarden-mark")
    if len(text) == len(data):
        return text, list(range(len(data) + 1))
    starts, at = [], 0
    for c in text:
        starts.append(at)
        at = broken[at] if at in broken else at + len(c.encode())
    return text, [*starts, at]


def in_bytes(match: dict, starts: list[int]) -> dict:
    a, b = starts[match["index"]], starts[match["index"] + match["length"]]
    return match | {"index": a, "length": b - a}


def contains_bytes(lexicon: Lexicon, data: bytes | None) -> bool:
    return contains(lexicon, decoded(data or b"")[0])


def first_match_bytes(lexicon: Lexicon, data: bytes | None) -> dict | None:
    text, starts = decoded(data or b"")
    found = first_match(lexicon, text)
    return found and in_bytes(found, starts)


def matches_bytes(lexicon: Lexicon, data: bytes | None) -> list[dict]:
    text, starts = decoded(data or b"")
    return [in_bytes(m, starts) for m in matches(lexicon, text)]


def censor_bytes(lexicon: Lexicon, data: bytes | None, mask: str = "*") -> bytes:
    blot = (validate_mask(mask) * MASK_LENGTH).encode()
    out = data or b""
    for _ in range(len(rowtext.tokens(decoded(out)[0])) + 2):
        found = matches_bytes(lexicon, out)
        if not found:
            return out
        cuts = [0, *[x for m in found for x in (m["index"], m["index"] + m["length"])], len(out)]
        out = blot.join(out[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
    return blot if matches_bytes(lexicon, out) else out

"""Readings of many texts, and what a lexicon finds in words and chunks, each looked at once.

A word is told by set operations to hold nothing; the others carry what they hold: a surface form, the
start of a phrase, anywhere keys inside, or a single letter. Chunks with symbols inside are kept with what
they stand for. Both memories are emptied at SEEN entries, so they are bounded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import regex

from textwarden.functions import batchtext as B
from textwarden.functions import charsets as C
from textwarden.functions import rowtext
from textwarden.functions.steps import COMPARISON
from textwarden.schemas import GuardOptions

SEEN = 200_000
#: Stands for any one letter in a broken chunk's pattern.
ANY = "\0"
#: ASCII characters that are neither letters nor digits.
ASCII_SYMBOLS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
WORD_ONLY = regex.compile(r"[\p{L}\p{M}\p{N}]+")
ASCII_PATTERN = {ord(c): C.DIGIT_LETTERS.get(c, c) if c.isalnum() else ANY for c in map(chr, range(128))}
#: number and text of a reading; its words, which a finder's readings have; of the normalized one the broken chunks.
Reading = tuple[int, str, B.Words | None, list[B.Piece]]


def composed(text: str | None) -> str:
    """NFKC."""
    return text or "" if not text or text.isascii() else unicodedata.normalize("NFKC", text)


def readings(texts: list[str | None], options: GuardOptions | None = None, compatibility: bool = True, finder: Finder | None = None, only: int = 3, chunked: bool = False) -> list[list[Reading]]:
    """Of each text the readings up to number only, without those that equal an earlier one; none of a blank text.

    Numbers are evasion bits too: 0 normalized, 1 squeezed, 2 folded, 3 both. A finder adds their words, chunked
    the broken chunks.
    """
    squeezing, folding = options is None or options.squeeze_repeated_letters, options is None or options.fold_lookalike_characters

    def many(chars) -> list[list[Reading]]:
        made = [(0, B.normalized(chars))]
        if squeezing and only >= 1:
            made.append((1, B.squeezed(made[0][1])))
        if folding and only >= 2:
            made.append((2, B.folded(made[0][1])))
            if squeezing and only >= 3:
                made.append((3, B.squeezed(made[-1][1])))
        apart = [B.apart(c) for _, c in made]
        words = [B.placed_words(c, t, finder.table, finder.least) if finder else [None] * len(t) for (_, c), t in zip(made, apart)]
        out = []
        for row, found, pieces in zip(zip(*apart), zip(*words), B.broken_chunks(made[0][1]) if chunked else [()] * len(apart[0])):
            out.append([(made[k][0], text, found[k], () if k else pieces) for k, text in enumerate(row) if text not in row[:k]] if row[0] else [])
        return out

    def one(text: str) -> list[Reading]:
        if finder or chunked:  # another noncharacter stands for it
            return readings([text.replace(B.END_TEXT, chr(B.END - 1))], options, compatibility, finder, only, chunked)[0]
        first = rowtext.normalize(text, COMPARISON - {"compatibilityForms"})
        forms = [(0, lambda: first), (1, lambda: rowtext.squeeze(first)), (2, lambda: rowtext.fold(first)), (3, lambda: rowtext.squeeze(rowtext.fold(first)))]
        found: list[Reading] = []
        for number, form in forms:
            if first and number <= only and (squeezing or not number & 1) and (folding or not number & 2) and (new := form()) not in [r[1] for r in found]:
                found.append((number, new, None, ()))
        return found

    return B.each(map(composed, texts) if compatibility else texts, many, one)


@dataclass(frozen=True)
class Held:
    """What a word holds."""

    order: int | None
    starts: bool
    inside: tuple[tuple[int, int], ...]  # numbers of anywhere keys, and where
    letter: bool


@dataclass(frozen=True)
class Chunk:
    """A chunk with symbols inside: its pattern and where that stands, and the entries that may be meant."""

    pattern: str
    start: int
    end: int
    bare: str | None
    bare_order: int | None
    masks: tuple[int, ...]  # numbers of maskable keys


class Masks:
    """Keys of one length as bits, for each place and character; a pattern's fit is their conjunction."""

    def __init__(self, keys: list[tuple[str, int]]):
        self.numbers = [at for _, at in keys]
        self.every = (1 << len(keys)) - 1
        self.places: list[dict[str, int]] = [{} for _ in keys[0][0]]
        for k, (key, _) in enumerate(keys):
            for place, c in zip(self.places, key):
                place[c] = place.get(c, 0) | 1 << k

    def fit(self, pattern: str) -> int:
        masks = pattern.count(ANY)
        if not masks or 2 * masks > len(pattern):
            return 0
        bits = self.every
        for place, c in zip(self.places, pattern):
            if c != ANY:
                bits &= place.get(c, 0)
                if not bits:
                    return 0
        return bits

    def named(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.numbers[low.bit_length() - 1])
            bits ^= low
        return out


class Windows:
    """Keys of any length as bits, to be found anywhere in a pattern."""

    def __init__(self, keys: list[tuple[str, int]]):
        self.keys = keys
        longest = max(len(key) for key, _ in keys)
        self.fitting = [sum(1 << k for k, (key, _) in enumerate(keys) if len(key) <= n) for n in range(longest + 1)]
        #: What a character leaves of the keys at each place, and what any other does: keys that have ended.
        self.places: list[tuple[dict[str, int], int]] = []
        for j in range(longest):
            place: dict[str, int] = {}
            for k, (key, _) in enumerate(keys):
                if j < len(key):
                    place[key[j]] = place.get(key[j], self.fitting[j]) | 1 << k
            self.places.append((place, self.fitting[j]))

    def named(self, pattern: str) -> set[int]:
        out, size, fitting, most = set(), len(pattern), self.fitting, len(self.fitting) - 1
        for i in range(size):
            bits = fitting[min(most, size - i)]
            for c, (place, ended) in zip(pattern[i : i + most], self.places):
                if c != ANY:
                    bits &= place.get(c, ended)
                if not bits:
                    break
            while bits:
                low = bits & -bits
                bits ^= low
                key, at = self.keys[low.bit_length() - 1]
                if 0 < 2 * pattern.count(ANY, i, i + len(key)) <= len(key):
                    out.add(at)
        return out


class Finder:
    def __init__(self, lexicon):
        self.lexicon = lexicon
        self.plain: set[str] = set()
        self.held: dict[str, Held] = {}
        self.solid: set[str] = set()
        self.broken: dict[str, Chunk] = {}
        self.keys = list(lexicon.anywhere)
        #: Of word characters alone, so each place of one lies inside a word.
        inner = [(n, key) for n, key in enumerate(self.keys) if WORD_ONLY.fullmatch(key)]
        self.loose = [(n, key) for n, key in enumerate(self.keys) if not WORD_ONLY.fullmatch(key)]
        self.least = min((len(key) for _, key in inner), default=0)
        self.heads: dict[str, list[tuple[int, str]]] = {}
        for n, key in inner:
            self.heads.setdefault(key[: self.least], []).append((n, key))
        wholes: dict[int, list[tuple[str, int]]] = {}
        for at, (key, whole, _) in enumerate(lexicon.maskable):
            if whole:
                wholes.setdefault(len(key), []).append((key, at))
        within = [(key, at) for at, (key, whole, _) in enumerate(lexicon.maskable) if not whole]
        self.wholes = {n: Masks(keys) for n, keys in wholes.items()}
        self.within = Windows(within) if within else None
        self.phrase_keys: dict[str, set[tuple[int, str]]] = {}
        for first, phrases in lexicon.starts.items():
            self.phrase_keys[first] = {(len(middle) + 2, " ".join([first, *middle, form])) for middle, last, _ in phrases for form in last}
        self.phrase_sizes = {first: sorted({n for n, _ in keys}) for first, keys in self.phrase_keys.items()}

        heads = {key[: self.least] for _, key in inner}
        self.table = B.Table({B.WORDS: [*lexicon.surface, *lexicon.starts], B.PAIRS: lexicon.whole, B.HEADS: heads})

    def readings(self, texts: list[str | None], compatibility: bool = True, only: int = 3) -> list[list[Reading]]:
        return readings(texts, self.lexicon.options, compatibility, self, only, True)

    def held_in(self, words: B.Words) -> list[tuple[int, Held]]:
        """The words of a reading that hold something, and their numbers."""
        out = []
        for i in words.hot:
            word = words.name(i)
            if word not in self.plain:
                if word not in self.held:
                    self._look(word)
                if (held := self.held.get(word)) is not None:
                    out.append((i, held))
        return out

    def held_in_parts(self, hot: list[tuple[int, Held]], runs: list[tuple[int, int]], parts: list[str]) -> list[tuple[int, Held]]:
        """The same of the parts that words become where runs of single letters are joined."""
        out, gone, k = [], 0, 0
        for a, b in [*runs, (1 << 62, 0)]:
            while k < len(hot) and hot[k][0] < a:
                out.append((hot[k][0] - gone, hot[k][1]))
                k += 1
            while k < len(hot) and hot[k][0] < b:
                k += 1
            if b:
                out += [(a - gone, held) for _, held in self.hot([parts[a - gone]])]
                gone += b - a - 1
        return out

    def hot(self, names: list[str]) -> list[tuple[int, Held]]:
        """The words that hold something, and their numbers."""
        if self.plain.issuperset(names):
            return []
        for word in set(names).difference(self.plain):
            if word not in self.held:
                self._look(word)
        held = self.held
        return [(i, held[w]) for i, w in enumerate(names) if w in held]

    def _look(self, word: str) -> None:
        lexicon, inside, least = self.lexicon, [], self.least
        if least:
            for i in range(len(word) - least + 1):
                for n, key in self.heads.get(word[i : i + least], ()):
                    if word.startswith(key, i):
                        inside.append((n, i))
        held = Held(lexicon.surface.get(word), word in lexicon.starts, tuple(inside), len(word) == 1 and C.is_letter(word))
        if held.order is not None or held.starts or held.inside or held.letter:
            self.held[word] = held
        else:
            self.plain.add(word)

    def rest(self) -> None:
        """Between texts: empties what is remembered where it is much."""
        for memory in (self.plain, self.held, self.solid, self.broken):
            if len(memory) > SEEN:
                memory.clear()

    def phrases(self, names: list[str], i: int) -> Iterator[str]:
        """The phrases, as keys, that start at a word, shorter ones first."""
        for n in self.phrase_sizes[names[i]]:
            key = " ".join(names[i : i + n])
            if (n, key) in self.phrase_keys[names[i]]:
                yield key

    def anywhere(self, text: str, starts, hot: list[tuple[int, Held]]) -> list[tuple[int, int]]:
        """(number of the key, place) of every occurrence of every anywhere key, in that order; starts has the words' places."""
        out = [(n, int(starts[i]) + at) for i, h in hot for n, at in h.inside]
        for n, key in self.loose:
            at = text.find(key)
            while at >= 0:
                out.append((n, at))
                at = text.find(key, at + 1)
        out.sort()
        return out

    def chunks(self, reads: list[Reading]) -> Iterator[tuple[int, int, Chunk]]:
        """Number, start and what it may be of each chunk with symbols inside, in the normalized reading."""
        for i, start, end in reads[0][3] if reads else ():
            piece = reads[0][1][start:end]
            if piece in self.solid:
                continue
            found = self.broken.get(piece)
            if found is None:
                found = self._chunk(piece)
                if found is None:
                    self.solid.add(piece)
                    continue
                self.broken[piece] = found
            yield i, start, found

    def _chunk(self, piece: str) -> Chunk | None:
        found = _ascii_pattern(piece) if piece.isascii() else chunk_pattern(piece)
        if found is None:
            return None
        pattern, start, end = found
        lexicon, bare, order, masks = self.lexicon, None, None, []
        if lexicon.options.join_spaced_letters:
            bare = pattern.replace(ANY, "")
            bare = bare if C.units(bare) >= 3 else None
            order = lexicon.surface.get(bare)
        if lexicon.options.fold_lookalike_characters:
            if keys := self.wholes.get(len(pattern)):
                masks += keys.named(keys.fit(pattern))
            if self.within:
                masks += self.within.named(pattern)
        return Chunk(pattern, start, end, bare, order, tuple(sorted(masks)))


def starts(parts: list[str]) -> list[int]:
    """Where each part starts in the line of them with spaces between."""
    return list(accumulate((len(p) + 1 for p in parts[:-1]), initial=0))


def letter_runs(hot: list[tuple[int, Held]]) -> list[tuple[int, int]]:
    """(first, past the last) of runs of two or more single letters."""
    out: list[tuple[int, int]] = []
    letters = [i for i, h in hot if h.letter]
    k = 0
    while k < len(letters):
        j = k
        while j + 1 < len(letters) and letters[j + 1] == letters[j] + 1:
            j += 1
        if j > k:
            out.append((letters[k], letters[j] + 1))
        k = j + 1
    return out


def with_runs_joined(names: list[str], runs: list[tuple[int, int]]) -> list[str]:
    out, at = [], 0
    for a, b in runs:
        out += names[at:a]
        out.append("".join(names[a:b]))
        at = b
    return out + names[at:]


def halves_may_join(a: str, b: str) -> bool:
    x, y = C.units(a), C.units(b)
    if x >= 2 and y >= 2:
        return x + y >= 4 and all("a" <= c <= "z" for c in a + b)
    return (x == 1) != (y == 1) and x + y >= 3 and C.VAV not in (a, b) and C.is_persian_letter(a[0]) and C.is_persian_letter(b[0])


def halves(lexicon, words: B.Words) -> list[int]:
    """Numbers of words that join with the next into an entry exactly."""
    return [i for i in words.pairs if (a := words.name(i)) + (b := words.name(i + 1)) in lexicon.whole and halves_may_join(a, b)]


def _ascii_pattern(piece: str) -> tuple[str, int, int] | None:
    inner = piece.strip(ASCII_SYMBOLS)
    if len(inner) < 3 or inner.lower() == inner.upper():
        return None
    pattern, start = inner.translate(ASCII_PATTERN), len(piece) - len(piece.lstrip(ASCII_SYMBOLS))
    return (pattern, start, start + len(inner)) if ANY in pattern else None


_letters: dict[str, str] = {}


def chunk_pattern(chunk: str) -> tuple[str, int, int] | None:
    """(pattern, start, end) of a chunk with at least one symbol and one letter inside, else None."""
    solid = [C.category(c)[0] == "L" or C.category(c) == "Nd" for c in chunk]
    if True not in solid:
        return None
    a, b = solid.index(True), len(solid) - solid[::-1].index(True)
    # a pair kept at the end counts as one unit, at the start as two
    if C.units(chunk[a:b]) - (b - a > 1 and not C.is_bmp(chunk[b - 1])) < 3:
        return None
    if not _letters:
        _letters.update(C.folded_letters() | C.DIGIT_LETTERS)
    out, letters, enclosed = [], 0, C.enclosed_table()
    for c in chunk[a:b]:
        if not C.is_bmp(c):
            out.append(enclosed.get(c, ANY))
            letters += c in enclosed
        elif C.is_letter_or_digit(c):
            out.append(_letters.get(c, c))
            letters += C.is_letter(c)
        elif C.category(c) not in ("Mn", "Mc", "Me", "Cf"):
            out.append(ANY)
    if ANY not in out or not letters:
        return None
    return "".join(out), a, b

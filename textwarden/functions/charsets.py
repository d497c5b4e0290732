"""Characters and tables that normalization, tokens and readings are built from.

Tables of more than a handful of entries come from rules over ``unicodedata``; the rest are fixed
values that results depend on, stated as they are.
"""

from __future__ import annotations

import unicodedata
from functools import cache

# White space, removed characters, unified letters, look-alikes, filler.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0                　"
DIACRITICS = "ًٌٍَُِّْ"
TATWEEL = "ـ"
ZERO_WIDTH = "​‌‍⁠﻿­"
BIDI_CONTROLS = "‎‏؜‪‫‬‭‮⁦⁧⁨⁩"
UNIFIED = {
    "ی": "يىۍێېےۓ",  # yeh
    "ک": "كڪګ",  # kaf
    "ا": "أإآٱٲٳٵ",  # alef
    "ه": "ةھۀہۃە",  # heh
}
ASCII_DIGITS = "0123456789"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SYMBOL_LETTERS = {"!": "i", "|": "i", "¡": "i", "€": "e", "@": "a", "$": "s"}
CYRILLIC = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h"}
GREEK = {"α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
UNDECOMPOSED_LATIN = {"ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "ƒ": "f", "ħ": "h", "ı": "i", "ß": "s"}
FILLER = "*+~^`=<>#%&•·♥❤"
ENCLOSED_ALPHABETS = (0x1F130, 0x1F150, 0x1F170, 0x1F1E6)
PERSIAN_SUFFIXES = ("هاشون", "هاتون", "هامون", "هایی", "های", "هاش", "هات", "هام", "ها", "تون", "شون", "مون", "ای", "یی", "اش", "ات", "ام", "ا")
HEH_SUFFIX_START = "ها"
HEH = "ه"
VAV = "و"

#: Regex classes, as Java writes them.
SPACE_CLASS = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BMP = r"\x{0}-\x{FFFF}"
JAVA_WORD = rf"(?:[\p{{L}}\p{{M}}\p{{N}}]|(?<=[\p{{L}}&&[{BMP}]])[\x{{200C}}\x{{200D}}])+"


def is_bmp(c: str) -> bool:
    return c <= "￿"


def category(c: str) -> str:
    return unicodedata.category(c)


def is_letter(c: str) -> bool:
    """A letter of the basic plane."""
    return is_bmp(c) and category(c)[0] == "L"


def is_letter_or_digit(c: str) -> bool:
    """A letter or decimal digit of the basic plane."""
    return is_bmp(c) and (category(c)[0] == "L" or category(c) == "Nd")


def is_persian_letter(c: str) -> bool:
    return "؀" <= c <= "ۿ" and is_letter(c)


def units(text: str) -> int:
    """Length in UTF-16 units, in which minimum lengths are counted."""
    return len(text) if text.isascii() or max(text) <= "\uffff" else len(text) + sum(c > "\uffff" for c in text)


@cache
def lower_table() -> dict[str, str]:
    """Letters of the basic plane whose lower case is another single character."""
    return {c: low for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and (low := c.lower()) != c and len(low) == 1}


@cache
def enclosed_table() -> dict[str, str]:
    """Squared, circled and regional-indicator letters to the plain letters they show."""
    return {chr(first + k): chr(ord("a") + k) for first in ENCLOSED_ALPHABETS for k in range(26)}


@cache
def latin_table() -> dict[str, str]:
    """Accented Latin letters to their plain letter, by the first character of their decomposition."""
    table: dict[str, str] = {}
    for c in map(chr, range(0x00C0, 0x0250)):
        first = unicodedata.normalize("NFD", c)[0]
        if first.isascii() and first.isalpha() and first.lower() != c:
            table[c] = first.lower()
    return table | UNDECOMPOSED_LATIN


@cache
def folded_letters() -> dict[str, str]:
    """All look-alikes but digits."""
    return SYMBOL_LETTERS | CYRILLIC | GREEK | latin_table()


def is_filler(c: str) -> bool:
    if c in FILLER:
        return True
    return c >= "\x80" and is_bmp(c) and not is_letter_or_digit(c) and category(c) in ("Mn", "Me", "So", "Sk")


def is_boundary(c: str) -> bool:
    """Whether c ends a run of word-like characters."""
    if c in WHITE_SPACE:
        return True
    if not is_bmp(c) or is_letter_or_digit(c) or c in SYMBOL_LETTERS or is_filler(c):
        return False
    return category(c) in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc")


@cache
def members(test) -> str:
    """All characters of the basic plane that pass the test."""
    return "".join(c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and test(c))


def _ranges(chars: str, one: str) -> str:
    codes, out, k = sorted(map(ord, set(chars))), [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(one % codes[k] + ("-" + one % codes[j] if j > k else ""))
        k = j + 1
    return "".join(out)


def java_class(chars: str) -> str:
    """The inside of a Java regex class of these characters, as ranges."""
    return _ranges(chars, r"\x{%X}")


def python_class(chars: str) -> str:
    """The inside of a Python regex class of these characters, as ranges."""
    return _ranges(chars, r"\U%08X")

"""Normalization steps, presets and their validation, shared by the column and the row path."""

from __future__ import annotations

from collections.abc import Iterable

from textwarden.functions import charsets as C

#: In the order in which they take effect.
STEPS = ("compatibilityForms", "removeDiacritics", "removeTatweel", "removeZeroWidth", "removeBidiControls", "unifyLetters", "asciiDigits", "lowerCase", "collapseRepeats", "collapseWhitespace")
STANDARD = frozenset(("compatibilityForms", "unifyLetters", "removeTatweel", "removeBidiControls", "collapseWhitespace"))
COMPARISON = STANDARD | frozenset(("removeDiacritics", "removeZeroWidth", "asciiDigits", "lowerCase", "collapseRepeats"))
PRESETS = {"comparison": COMPARISON, "standard": STANDARD, "none": frozenset()}


def resolve(steps: str | Iterable[str]) -> frozenset[str]:
    """The steps a preset or a collection of names stands for."""
    if isinstance(steps, str):
        if steps not in PRESETS:
            raise ValueError(f"unknown preset {steps!r}; presets are {', '.join(PRESETS)}")
        return PRESETS[steps]
    try:
        chosen = frozenset(steps)
    except TypeError:
        raise TypeError("steps must be a preset or step names") from None
    unknown = [s for s in chosen if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown normalization step {unknown[0]!r}")
    return chosen


def character_table(steps: frozenset[str]) -> dict[str, str]:
    """What the per-character steps make of each character they touch; '' removes it."""
    table: dict[str, str] = {}
    if "lowerCase" in steps:
        table |= C.lower_table()
    if "asciiDigits" in steps:
        table |= dict(zip(C.ARABIC_DIGITS + C.PERSIAN_DIGITS, C.ASCII_DIGITS * 2))
    if "unifyLetters" in steps:
        table |= {c: to for to, chars in C.UNIFIED.items() for c in chars}
    for step, chars in (("removeDiacritics", C.DIACRITICS), ("removeTatweel", C.TATWEEL), ("removeZeroWidth", C.ZERO_WIDTH), ("removeBidiControls", C.BIDI_CONTROLS)):
        if step in steps:
            table |= dict.fromkeys(chars, "")
    return table

"""Value classes, schemas and validation of the public interface."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("wholeWord", "anywhere")
CATEGORIES = ("uncategorized", "profanity", "sexual", "insult", "slur", "harassment", "mild")
#: Evasion names by bit: 1, 2, 4.
EVASIONS = ("repeatedLetters", "lookalikeCharacters", "splitWord")

ENTRY_SCHEMA = "text string, mode string, category string"
LIST_SCHEMA = f"list string, entry_order int, {ENTRY_SCHEMA}"
MATCH_TYPE = "struct<text:string,mode:string,category:string,evasion:array<string>,index:int,length:int>"
MATCHES_TYPE = f"array<{MATCH_TYPE}>"


@dataclass(frozen=True)
class BannedWord:
    """An entry of a word list; equal by all three values."""

    text: str
    mode: str = "wholeWord"
    category: str = "uncategorized"

    def __post_init__(self):
        if not isinstance(self.text, str):
            raise TypeError(f"text must be a string, not {type(self.text).__name__}")
        named("mode", self.mode, MODES)
        named("category", self.category, CATEGORIES)


@dataclass(frozen=True)
class GuardOptions:
    squeeze_repeated_letters: bool = True
    fold_lookalike_characters: bool = True
    join_spaced_letters: bool = True

    def __post_init__(self):
        for name, value in vars(self).items():
            if not isinstance(value, bool):
                raise TypeError(f"{name} must be True or False, not {type(value).__name__}")


class WordListFormatError(ValueError):
    """A word list that cannot be read; ``line`` counts from 1."""

    def __init__(self, line: int, name: str):
        super().__init__(f"Line {line}: unknown word category '{name}'.")
        self.line = line


def named(what: str, value: object, names: tuple[str, ...]) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{what} must be a string, not {type(value).__name__}")
    if value not in names:
        raise ValueError(f"unknown {what} {value!r}; it must be one of {', '.join(names)}")
    return value


def evasion_names(bits: int) -> list[str]:
    return [name for k, name in enumerate(EVASIONS) if bits >> k & 1]

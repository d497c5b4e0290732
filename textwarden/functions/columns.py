"""Normalization, tokens, squeeze and fold as Columns.

What looks at each character's neighbours or at large tables is an Arrow function over ``batchtext``, some
20 to 80 times as fast as the JVM's regular expressions; a few characters' replacement is one translate
call. Columns follow the reference's treatment of missing text: null counts as the empty string.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textwarden.functions import batchtext as B
from textwarden.functions import charsets as C
from textwarden.functions import rowtext
from textwarden.functions.steps import character_table, resolve


def _column(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Text of these characters alone is in NFKC; everything else is tested by the Arrow function.
NFKC_STABLE = r"^[\x{0}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{621}-\x{64A}\x{660}-\x{66F}\x{671}\x{672}\x{679}-\x{6DB}\x{6E5}-\x{6E6}\x{6EE}-\x{6FF}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2027}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2030}-\x{2032}]*$"


def nfkc(text: Column | str) -> Column:
    """NFKC in Arrow batches, only of text that it may change: for the rest nulls go to Python."""

    @F.pandas_udf(StringType())
    def normalized(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    column = _column(text)
    return F.coalesce(normalized(F.when(~column.rlike(NFKC_STABLE), column)), column)


def translated(text: Column, table: dict[str, str]) -> Column:
    """One translate call for all replacements; removed characters come last, having no counterpart."""
    kept = [c for c in table if table[c]]
    gone = [c for c in table if not table[c]]
    return F.translate(text, "".join([*kept, *gone]), "".join(table[c] for c in kept))


def _arrow(text: Column | str, kind: str, many, one, before=None) -> Column:
    """An Arrow function: many of slices of texts, one of a text that no slice can hold; before prepares each."""
    of = pa.list_(pa.string()) if kind == "array<string>" else pa.string()

    @F.arrow_udf(kind)
    def run(batch: pa.Array) -> pa.Array:
        texts = batch.to_pylist()
        return pa.array(B.each(map(before, texts) if before else texts, many, one), of)

    return run(F.col(text) if isinstance(text, str) else text)


def composed(text: str | None) -> str:
    return text or "" if not text or text.isascii() else unicodedata.normalize("NFKC", text)


def normalize(text: Column | str, steps: str | Iterable[str] = "comparison", compatibility: bool = True) -> Column:
    """The text after the steps. compatibility=False leaves NFKC out, for text known to be in it."""
    chosen = resolve(steps)
    composing, rest = compatibility and "compatibilityForms" in chosen, chosen - {"compatibilityForms"}
    if "collapseRepeats" in chosen:
        return _arrow(text, "string", lambda chars: B.apart(B.normalized(chars, rest)), lambda t: rowtext.normalize(t, rest), composed if composing else None)
    out = nfkc(text) if composing else _column(text)
    if table := character_table(chosen):
        out = translated(out, table)
    if "collapseWhitespace" in chosen:
        out = F.trim(F.regexp_replace(out, f"[{C.SPACE_CLASS}]+", " "))
    return out


def normalize_table(df: DataFrame, text: str, to: str, steps: str | Iterable[str] = "comparison") -> DataFrame:
    """Adds column ``to``."""
    return df.withColumn(to, normalize(text, steps))


def to_persian_digits(text: Column | str) -> Column:
    return F.translate(_column(text), C.ASCII_DIGITS, C.PERSIAN_DIGITS)


def to_ascii_digits(text: Column | str) -> Column:
    return normalize(text, ["asciiDigits"])


def tokenize(text: Column | str) -> Column:
    """Maximal runs of word characters."""
    return _arrow(text, "array<string>", B.words, rowtext.words)


def is_word(segment: Column) -> Column:
    return segment.rlike(f"^{C.JAVA_WORD}$")


def segments(text: Column | str) -> Column:
    """Words and what stands between them, alternating; their concatenation is the text."""
    inside = rf"(?:[\p{{L}}\p{{M}}\p{{N}}]|(?<=[\p{{L}}&&[{C.BMP}]])[\x{{200C}}\x{{200D}}])"
    return F.regexp_extract_all(_column(text), F.lit(f"(?s)({inside}+|(?:(?!{inside}).)+)"), F.lit(1))


def squeeze(text: Column | str) -> Column:
    """Runs of a repeated character, other than a space, down to one; leading U+0000 goes."""
    return _arrow(text, "string", lambda chars: B.apart(B.squeezed(chars)), rowtext.squeeze)


def fold(text: Column | str) -> Column:
    """Look-alikes as the letters they imitate, filler dropped; digits only in runs with a letter."""
    return _arrow(text, "string", lambda chars: B.apart(B.folded(chars)), rowtext.fold)

"""The public interface: a guard over columns of messages, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators import relational, rowmatch
from textwarden.operators.lexicon import compile_lexicon
from textwarden.schemas import MATCH_TYPE, MATCHES_TYPE, BannedWord, GuardOptions


class Guard:
    """Finds and censors banned words.

    Columns are Arrow functions over the compiled lexicon, which travels with the function and is the
    size of the word list. They hold no state, so they work on streams. Null messages are clean: false,
    no match, an empty array, an empty string.
    """

    def __init__(self, words: Iterable[BannedWord], options: GuardOptions | None = None):
        self.lexicon = compile_lexicon(words, options)

    @property
    def count(self) -> int:
        """Entries that have an effect: neither blank nor repeated."""
        return self.lexicon.count

    def _column(self, name: str, kind: str, text: Column | str, **more) -> Column:
        lexicon, function = self.lexicon, getattr(rowmatch, name)

        def made(batch: pd.Series) -> Iterable:
            """What the function makes of each text, of equal ones once."""
            texts = batch.tolist()
            distinct = list(dict.fromkeys(texts))
            if len(distinct) == len(texts):
                return of_each(texts)
            found = dict(zip(distinct, of_each(distinct)))
            return [found[t] for t in texts]

        def of_each(batch: list) -> Iterator:
            """Readings are made of some texts together."""
            for a in range(0, len(batch), relational.TEXTS):
                texts = batch[a : a + relational.TEXTS]
                if name == "censored":
                    yield from function(lexicon, texts, **more)
                elif name.endswith("_bytes"):
                    yield from (function(lexicon, t, **more) for t in texts)
                else:
                    yield from (function(lexicon, t, reads, **more) for t, reads in zip(texts, lexicon.finder.readings(texts)))

        @F.pandas_udf(kind)
        def run(batch: pd.Series) -> pd.Series:
            return pd.Series(list(made(batch)), index=batch.index, dtype=object)

        @F.pandas_udf(kind)
        def run_rows(batch: pd.Series) -> pd.DataFrame:
            empty = dict.fromkeys(("text", "mode", "category", "evasion", "index", "length"))
            return pd.DataFrame([m or empty for m in made(batch)], columns=list(empty))

        column = F.col(text) if isinstance(text, str) else text
        return (run_rows if kind.startswith("struct") else run)(column)

    def contains(self, text: Column | str) -> Column:
        return self._column("contains", "boolean", text)

    def first_match(self, text: Column | str) -> Column:
        """The hit that needs the least evasion, which need not be the leftmost; null if clean."""
        found = self._column("first_match", MATCH_TYPE, text)
        return F.when(found["text"].isNotNull(), found)

    def matches(self, text: Column | str) -> Column:
        return self._column("matches", MATCHES_TYPE, text)

    def censor(self, text: Column | str, mask: str = "*") -> Column:
        return self._column("censored", "string", text, mask=rowmatch.validate_mask(mask))

    def matches_bytes(self, data: Column | str) -> Column:
        """As matches, of binary messages; index and length count bytes."""
        return self._column("matches_bytes", MATCHES_TYPE, data)

    def censor_bytes(self, data: Column | str, mask: str = "*") -> Column:
        return self._column("censor_bytes", "binary", data, mask=rowmatch.validate_mask(mask))

    def contains_bytes(self, data: Column | str) -> Column:
        return self._column("contains_bytes", "boolean", data)

    def first_match_bytes(self, data: Column | str) -> Column:
        """As first_match, of binary messages; index and length count bytes."""
        found = self._column("first_match_bytes", MATCH_TYPE, data)
        return F.when(found["text"].isNotNull(), found)

    def match_table(self, df: DataFrame, text: str, *keep: str) -> DataFrame:
        """A row for each match, with the columns of keep."""
        found = df.select(*keep, F.explode(self.matches(text)).alias("m"))
        return found.select(*keep, "m.*")

    def first_table(self, df: DataFrame, text: str, *keep: str) -> DataFrame:
        """A row for each message with a match, the first, as m, with the columns of keep.

        By explode: a filter on the match would be moved below it and make it again.
        """
        return df.select(*keep, F.explode(F.array_compact(F.array(self.first_match(text)))).alias("m"))

    def hit_table(self, df: DataFrame, doc: str, text: str) -> DataFrame:
        """All hits by joins, for batches: the id, reading, evasion, stage, place, key, entry_order."""
        return relational.hits(df, doc, text, self.lexicon)

    def flagged(self, df: DataFrame, doc: str, text: str) -> DataFrame:
        """The rows with a hit, by a semi join."""
        return df.join(self.hit_table(df, doc, text).select(doc).distinct(), doc, "left_semi")

    def clean(self, df: DataFrame, doc: str, text: str) -> DataFrame:
        """The rows without a hit, by an anti join."""
        return df.join(self.hit_table(df, doc, text).select(doc).distinct(), doc, "left_anti")


def matched_text(text: Column | str, match: Column) -> Column:
    """The part of the message that a match covers."""
    return F.substring(F.col(text) if isinstance(text, str) else text, match["index"] + 1, match["length"])


def register(spark: SparkSession, guard: Guard) -> None:
    """SQL functions guard_normalize, guard_tokenize, guard_contains, guard_matches, guard_censor, and
    the table function guard_match_rows(text)."""
    from pyspark.sql.functions import udtf

    from textwarden.functions import rowtext

    lexicon = guard.lexicon

    @F.pandas_udf("string")
    def normalize(text: pd.Series, preset: pd.Series) -> pd.Series:
        return pd.Series([rowtext.normalize(t, p) for t, p in zip(text, preset)], dtype=object)

    @F.pandas_udf("array<string>")
    def tokenize(text: pd.Series) -> pd.Series:
        return pd.Series([[w for w, _, _ in rowtext.tokens(t or "")] for t in text], dtype=object)

    @F.pandas_udf("boolean")
    def contains(text: pd.Series) -> pd.Series:
        return pd.Series([rowmatch.contains(lexicon, t) for t in text], dtype=object)

    @F.pandas_udf(MATCHES_TYPE)
    def matches(text: pd.Series) -> pd.Series:
        return pd.Series([rowmatch.matches(lexicon, t) for t in text], dtype=object)

    @F.pandas_udf("string")
    def censor(text: pd.Series) -> pd.Series:
        return pd.Series([rowmatch.censor(lexicon, t) for t in text], dtype=object)

    class MatchRows:
        def eval(self, text: str):
            for m in rowmatch.matches(lexicon, text):
                yield m["text"], m["category"], m["index"], m["length"]

    for name, function in (("normalize", normalize), ("tokenize", tokenize), ("contains", contains), ("matches", matches), ("censor", censor)):
        spark.udf.register(f"guard_{name}", function)
    spark.udtf.register("guard_match_rows", udtf(MatchRows, returnType="text string, category string, index int, length int"))

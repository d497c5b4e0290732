"""Matching as a join: what the texts may be found by, and the lexicon's tables, for batches.

Texts are read once, in Arrow batches: each reading brings the keys it may be found by - words, phrases,
joined letters, halves, chunks, places of anywhere keys - as rows, which one join with the lexicon's keys
turns into hits. Nothing but these rows is moved. Up to BROADCAST_KEYS keys the rows are those of keys that
the lexicon has, and the keys are broadcast; of a longer list all candidates join by shuffle.

Hits have: the id, reading, evasion (bits), stage, place, key, entry_order, rank. Stages follow the order
of preference: 0 words and phrases, 1 anywhere, 2 joined letters, 3 anywhere in joined letters, 4 split
halves, 5 broken chunks. Places are numbers of tokens, of characters in stages 1 and 3, and of chunks in
stage 5; rank orders what is found at one place, and before the place in stages 1 and 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textwarden.functions import columns as N
from textwarden.functions.batchtext import Words
from textwarden.operators import wordfind
from textwarden.operators.lexicon import Lexicon, surfaces

SPLIT_BIT, LOOKALIKE_BIT = 4, 2
#: Stands for any one letter in a pattern of the SQL equivalents.
MASK = "\ue000"
#: Rows of a batch that goes back to Spark, and texts read together.
ROWS, TEXTS = 8192, 64


def text_rows(df: DataFrame, doc: str, text: str, fields: str, make: Callable[[list[str | None]], Iterable[list[tuple]]]) -> DataFrame:
    """(doc, *fields): for each text the rows that make gives for it; make gets some texts at a time."""
    picked = df.select(doc, F.col(text).alias("__text"))
    schema = StructType([picked.schema[0], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for a in range(0, batch.num_rows, TEXTS):
                for k, found in enumerate(make(batch.column(1).slice(a, TEXTS).to_pylist()), a):
                    at += [k] * len(found)
                    rows += found
                if rows and (len(rows) >= ROWS or a + TEXTS >= batch.num_rows):
                    values = [pa.array(v, f.type) for v, f in zip(zip(*rows), list(arrow)[1:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(arrow.field(0).type), *values], schema=arrow)
                    at, rows = [], []

    return picked.mapInArrow(run, schema)


def readings(df: DataFrame, doc: str, text: str, lexicon: Lexicon | None = None, compatibility: bool = True) -> DataFrame:
    """(doc, reading, evasion, text): up to four rows a message, one for each different reading."""
    options = lexicon.options if lexicon else None

    def make(texts: list[str | None]) -> list[list[tuple]]:
        return [[(n, n, t) for n, t, _, _ in reads] for reads in wordfind.readings(texts, options, compatibility)]

    return text_rows(df, doc, text, "reading int, evasion int, text string", make)


def token_table(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, tok, start, end) of a text column, end exclusive, places in code points."""
    parts = df.select(doc, F.posexplode_outer(N.segments(text)).alias("seg", "part"))
    before = Window.partitionBy(doc).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))
    placed = parts.select(doc, "seg", "part", start.cast("long").alias("start")).filter(N.is_word(F.col("part")))
    pos = F.row_number().over(Window.partitionBy(doc).orderBy("seg")) - 1
    return placed.select(doc, pos.cast("int").alias("pos"), F.col("part").alias("tok"), "start", (F.col("start") + F.length("part")).alias("end"))


#: Rows of the key table up to which it is broadcast.
BROADCAST_KEYS = 1_000_000
FOUND = "reading int, evasion int, stage int, kind string, place int, key string"


def key_rows(lexicon: Lexicon) -> list[tuple[str, str, str, int, int]]:
    """(kind, key, name, entry_order, rank): what a found key of a kind stands for."""
    rows = [("surface", key, key, order, 0) for key, order in lexicon.surface.items()]
    for k, (words, order) in enumerate(lexicon.phrases):
        rows += [("surface", key, key, order, 1 + k) for rank, form in surfaces(words[-1]) if rank < 0 or rank % 2 == 0 for key in [" ".join([*words[:-1], form])]]
    rows += [("whole", key, key, order, 0) for key, order in lexicon.words.items()] + [("whole", key, key, order, 1) for key, order in lexicon.anywhere.items()]
    rows += [("anywhere", key, key, order, k) for k, (key, order) in enumerate(lexicon.anywhere.items())]
    return rows + [("mask", f"{'w' if whole else 'a'}{key}", key, order, 1 + k) for k, (key, whole, order) in enumerate(lexicon.maskable)]


def longest(lexicon: Lexicon) -> int:
    return max([1, *[len(words) for words, _ in lexicon.phrases]])


#: What may be looked for in a text.
WORDS, PHRASES, ANYWHERE, JOINED, HALVES, CHUNKS = KINDS = ("words", "phrases", "anywhere", "joined", "halves", "chunks")


class Candidates:
    """The keys by which texts may be found: of those the lexicon has, or where known is false of all."""

    def __init__(self, lexicon: Lexicon, kinds: Iterable[str], known: bool):
        self.lexicon, self.kinds, self.known, self.most = lexicon, frozenset(kinds), known, longest(lexicon)

    def of(self, reads: list[wordfind.Reading]) -> list[tuple]:
        """FOUND rows of the readings of one text."""
        finder, kinds, out = self.lexicon.finder, self.kinds, []
        finder.rest()
        for number, text, words, _ in reads if kinds - {CHUNKS} else ():
            hot = finder.held_in(words)
            if kinds & {WORDS, PHRASES} and (hot or not self.known):
                self.words(out, number, number, 0, words if self.known else words.names, hot)
            if ANYWHERE in kinds:
                out += [(number, number, 1, "anywhere", at, finder.keys[n]) for n, at in finder.anywhere(text, words.starts, hot)]
            if JOINED in kinds and (runs := wordfind.letter_runs(hot)):
                parts = wordfind.with_runs_joined(words.names, runs)
                bits, parts_hot = number | SPLIT_BIT, finder.held_in_parts(hot, runs, parts)
                self.words(out, number, bits, 2, parts, parts_hot)
                if ANYWHERE in kinds and (finder.loose or any(h.inside for _, h in parts_hot)):
                    out += [(number, bits, 3, "anywhere", at, finder.keys[n]) for n, at in finder.anywhere(" ".join(parts), wordfind.starts(parts), parts_hot)]
            if HALVES in kinds:
                pairs = wordfind.halves(self.lexicon, words) if self.known else [i for i, (a, b) in enumerate(zip(words.names, words.names[1:])) if wordfind.halves_may_join(a, b)]
                out += [(number, number | SPLIT_BIT, 4, "whole", i, words.name(i) + words.name(i + 1)) for i in pairs]
        if CHUNKS in kinds and reads:
            for i, _, chunk in finder.chunks(reads):
                if chunk.bare_order is not None or chunk.bare and not self.known:
                    out.append((0, SPLIT_BIT, 5, "surface", i, chunk.bare))
                for at in chunk.masks:
                    key, whole, _ = self.lexicon.maskable[at]
                    out.append((0, LOOKALIKE_BIT, 5, "mask", i, ("w" if whole else "a") + key))
        return out

    def words(self, out: list[tuple], number: int, bits: int, stage: int, names: list[str] | Words, hot: list) -> None:
        """Words, and runs of words, each of which may be a surface form of an entry."""
        finder = self.lexicon.finder
        if self.known:
            for i, held in hot:
                if WORDS in self.kinds and held.order is not None:
                    out.append((number, bits, stage, "surface", i, names[i]))
                if PHRASES in self.kinds and held.starts:
                    out += [(number, bits, stage, "surface", i, key) for key in finder.phrases(names, i)]
            return
        for n in range(1, self.most + 1):
            if (WORDS if n == 1 else PHRASES) in self.kinds:
                out += [(number, bits, stage, "surface", i, " ".join(names[i : i + n])) for i in range(len(names) - n + 1)]


def found_hits(df: DataFrame, doc: str, text: str, lexicon: Lexicon, kinds: Iterable[str] = KINDS, compatibility: bool = True, only: int = 3) -> DataFrame:
    """Hits of some kinds in the readings up to number only."""
    rows = key_rows(lexicon)
    known = len(rows) <= BROADCAST_KEYS
    candidates = Candidates(lexicon, kinds, known)

    def make(texts: list[str | None]) -> list[list[tuple]]:
        finder = lexicon.finder if candidates.kinds - {CHUNKS} else None
        return [candidates.of(reads) for reads in wordfind.readings(texts, lexicon.options, compatibility, finder, only, CHUNKS in candidates.kinds)]

    each = text_rows(df, doc, text, FOUND, make)
    keys = df.sparkSession.createDataFrame(rows, "kind string, key string, name string, entry_order int, rank int")
    hit = each.join(F.broadcast(keys) if known else keys, ["kind", "key"])
    return hit.select(doc, "reading", "evasion", "stage", F.col("place").cast("long").alias("place"), F.col("name").alias("key"), "entry_order", "rank")


def word_hits(df: DataFrame, doc: str, text: str, lexicon: Lexicon, compatibility: bool = True, only: int = 3) -> DataFrame:
    return found_hits(df, doc, text, lexicon, [WORDS], compatibility, only)


def phrase_hits(df: DataFrame, doc: str, text: str, lexicon: Lexicon, compatibility: bool = True) -> DataFrame:
    return found_hits(df, doc, text, lexicon, [PHRASES], compatibility)


def anywhere_hits(df: DataFrame, doc: str, text: str, lexicon: Lexicon, compatibility: bool = True) -> DataFrame:
    return found_hits(df, doc, text, lexicon, [ANYWHERE], compatibility)


def split_hits(df: DataFrame, doc: str, text: str, lexicon: Lexicon, compatibility: bool = True) -> DataFrame:
    return found_hits(df, doc, text, lexicon, [HALVES], compatibility)


def chunk_hits(df: DataFrame, doc: str, text: str, lexicon: Lexicon, compatibility: bool = True) -> DataFrame:
    return found_hits(df, doc, text, lexicon, [CHUNKS], compatibility, only=0)


def patterns(df: DataFrame, doc: str, text: str, lexicon: Lexicon, compatibility: bool = True) -> DataFrame:
    """(doc, place, pattern): chunks with symbols inside; U+0000 stands for each symbol."""

    def make(texts: list[str | None]) -> Iterator[list[tuple]]:
        for reads in wordfind.readings(texts, lexicon.options, compatibility, only=0, chunked=True):
            lexicon.finder.rest()
            yield [(i, chunk.pattern) for i, _, chunk in lexicon.finder.chunks(reads)]

    return text_rows(df, doc, text, "place int, pattern string", make)


def joined_tokens(df: DataFrame, doc: str, text: str, lexicon: Lexicon, compatibility: bool = True) -> DataFrame:
    """(doc, reading, evasion, place, key, letters): runs of two or more adjacent single letters, put together."""

    def make(texts: list[str | None]) -> Iterator[list[tuple]]:
        finder = lexicon.finder
        for reads in finder.readings(texts, compatibility):
            finder.rest()
            yield [(n, n, a, "".join(words.names[a:b]), b - a) for n, _, words, _ in reads for a, b in wordfind.letter_runs(finder.held_in(words))]

    return text_rows(df, doc, text, "reading int, evasion int, place int, key string, letters long", make)


def hits(df: DataFrame, doc: str, text: str, lexicon: Lexicon, compatibility: bool = True) -> DataFrame:
    """All hits of all messages, from every stage."""
    options, kinds = lexicon.options, [WORDS, PHRASES, ANYWHERE]
    if options.join_spaced_letters:
        kinds += [JOINED, HALVES]
    if options.join_spaced_letters or options.fold_lookalike_characters:
        kinds.append(CHUNKS)
    return found_hits(df, doc, text, lexicon, kinds, compatibility)


def first_hits(found: DataFrame, doc: str) -> DataFrame:
    """One row a message: the hit that the least evasion undone brings, in the order of readings and stages.

    Within a stage the earliest place is first, but in anywhere stages the earliest key of the list.
    Broken chunks come after all readings.
    """
    anywhere = F.col("stage").isin(1, 3)
    order = F.struct(
        F.when(F.col("stage") == 5, 4).otherwise(F.col("reading")).alias("r"),
        "stage",
        F.when(anywhere, F.col("rank")).otherwise(F.col("place")).alias("ord1"),
        F.when(anywhere, F.col("place")).otherwise(F.col("rank")).alias("ord2"),
        "entry_order",
    )
    best = found.groupBy(doc).agg(F.min_by(F.struct("reading", "evasion", "stage", "place", "key", "entry_order"), order).alias("h"))
    return best.select(doc, "h.*")


def merge_regions(candidates: DataFrame, doc: str) -> DataFrame:
    """(doc, start, end, entry_order, evasion) from (doc, start, end, hit_length, entry_order, evasion).

    Gaps and islands: a candidate that starts before the furthest end so far joins the island; touching
    is no overlap. The entry is that of the longest hit, then the first in the list; its evasion is the
    least among its hits in the island.
    """
    order = Window.partitionBy(doc).orderBy(F.asc_nulls_last("start"), F.desc_nulls_last("end"), F.asc_nulls_last("entry_order"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    islands = candidates.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = F.max_by("entry_order", F.struct("hit_length", -F.col("entry_order")))
    per_entry = islands.groupBy(doc, "island", "entry_order").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("hit_length").alias("hit_length"), F.min("evasion").alias("evasion"))
    regions = per_entry.groupBy(doc, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("entry_order"), F.max_by("evasion", F.struct("hit_length", -F.col("entry_order"))).alias("evasion"))
    return regions.select(doc, "start", "end", "entry_order", "evasion")

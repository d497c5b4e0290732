"""Word lists: the text format, as driver values and as DataFrames, and selection by category.

Format: ``#`` starts a comment line, ``[category]`` a section, ``~`` before an entry makes it match
anywhere, all else is a whole word or phrase. Entries before a section are uncategorized.

Full lists are data, not code: ``Lists(folder)`` reads them from a folder that the caller or the
environment variable TEXTWARDEN_LISTS names. Without one, a small starter list serves.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.functions import charsets as C
from textwarden.schemas import CATEGORIES, LIST_SCHEMA, BannedWord, WordListFormatError, named

#: Names of the lists in a folder, in the order of their entries.
LIST_NAMES = ("persian", "finglish", "english")


def section(line: str) -> str | None:
    """The name inside a section heading, None if the line is none."""
    if line.startswith("[") and line.endswith("]") and len(line) > 2:
        return line[1:-1].strip(C.WHITE_SPACE)
    return None


def known_category(name: str) -> str | None:
    low = "".join(C.lower_table().get(c, c) for c in name)
    return low if name and all(C.is_letter(c) for c in name) and low in CATEGORIES else None


def parse(text: str) -> list[BannedWord]:
    """The entries of a list, in order."""
    if not isinstance(text, str):
        raise TypeError(f"text must be a string, not {type(text).__name__}")
    out: list[BannedWord] = []
    category = "uncategorized"
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.strip(C.WHITE_SPACE)
        if not line or line.startswith("#"):
            continue
        name = section(line)
        if name is not None:
            if (category := known_category(name)) is None:
                raise WordListFormatError(number, name)
        else:
            anywhere = line.startswith("~")
            entry = line[1:].strip(C.WHITE_SPACE) if anywhere else line
            if entry:
                out.append(BannedWord(entry, "anywhere" if anywhere else "wholeWord", category))
    return out


def load(source) -> list[BannedWord]:
    """A list from a path, or from an open text or binary file, which stays open."""
    if hasattr(source, "read"):
        data = source.read()
        name = getattr(source, "name", "file")
    else:
        name = os.fspath(source)
        with open(name, "rb") as f:
            data = f.read()
    if isinstance(data, bytes):
        try:
            data = data.decode()
        except UnicodeDecodeError as e:
            raise UnicodeDecodeError(e.encoding, e.object, e.start, e.end, f"{e.reason} in {name}") from None
    return parse(data.removeprefix("﻿"))


def parse_table(lines: DataFrame) -> DataFrame:
    """(list, line, text, mode, category) of lists given as (list, content), the content whole.

    Headings carry forward by a window within a list; an unknown heading fails the query.
    """
    blanks = C.WHITE_SPACE
    rows = lines.select("list", F.posexplode(F.split(F.regexp_replace("content", r"^\x{FEFF}", ""), "\n")).alias("at", "raw")).select("list", (F.col("at") + 1).alias("line"), F.btrim("raw", F.lit(blanks)).alias("raw"))
    rows = rows.filter((F.col("raw") != "") & ~F.startswith("raw", F.lit("#")))
    heading = F.startswith("raw", F.lit("[")) & F.endswith("raw", F.lit("]")) & (F.length("raw") > 2)
    name = F.when(heading, F.btrim(F.substring("raw", F.lit(2), F.length("raw") - 2), F.lit(blanks)))
    low = F.when(name.rlike(r"^\p{L}+$"), F.lower(name))
    checked = F.when(low.isin(*CATEGORIES), low).when(heading, F.raise_error(F.concat(F.lit("Line "), F.col("line"), F.lit(": unknown word category '"), name, F.lit("'."))).cast("string"))
    carried = F.last("named", ignorenulls=True).over(Window.partitionBy("list").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("*", heading.alias("heading"), checked.alias("named")).withColumn("category", F.coalesce(carried, F.lit("uncategorized")))
    anywhere = F.startswith("raw", F.lit("~"))
    entry = F.when(anywhere, F.btrim(F.substring("raw", F.lit(2), F.length("raw")), F.lit(blanks))).otherwise(F.col("raw"))
    return rows.filter(~F.col("heading")).select("list", "line", entry.alias("text"), F.when(anywhere, "anywhere").otherwise("wholeWord").alias("mode"), "category").filter("text <> ''")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Lists from files that Spark reads; the list's name is the file's path. Invalid UTF-8 fails."""
    files = spark.read.format("binaryFile").load(path)
    return parse_table(files.select(F.col("path").alias("list"), F.expr("validate_utf8(cast(content AS string))").alias("content")))


def as_table(spark: SparkSession, words: Iterable[BannedWord], name: str = "list") -> DataFrame:
    return spark.createDataFrame([(name, k, w.text, w.mode, w.category) for k, w in enumerate(words)], LIST_SCHEMA)


def concatenated(*lists: DataFrame) -> DataFrame:
    """Lists (LIST_SCHEMA) one after the other as one: entry_order counts on, list names stay."""
    tagged = [df.withColumn("__at", F.lit(k)) for k, df in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, tagged)
    # a row a list: where its entries start
    sizes = rows.groupBy("__at").agg((F.max("entry_order") + 1).alias("n"))
    before = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__at", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("start"))
    return rows.join(F.broadcast(starts), "__at").select("list", (F.col("entry_order") + F.col("start")).alias("entry_order"), "text", "mode", "category")


def profile(entries: DataFrame, most: int = 5) -> DataFrame:
    """Of each category: entries, how many match anywhere, its first and last entries in list order, and flags.

    distinct says that no text and mode is listed twice, filled that no entry is blank. Word lists are
    small, so a category's entries may meet in one task.
    """
    listed = F.array_sort(F.collect_list(F.struct("entry_order", "text")))
    texts = entries.groupBy("category").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("mode") == "anywhere").alias("anywhere"), F.transform(listed, lambda x: x["text"]).alias("l"), (F.count_distinct("text", "mode") == F.count(F.lit(1))).alias("distinct"), (F.count_if(F.btrim("text", F.lit(C.WHITE_SPACE)) == "") == 0).alias("filled"))
    return texts.select("category", "entries", "anywhere", F.slice("l", 1, most).alias("first"), F.slice("l", F.greatest(F.size("l") - most + 1, F.lit(1)), F.lit(most)).alias("last"), "distinct", "filled")


def selected(words: Iterable[BannedWord], categories: Iterable[str]) -> list[BannedWord]:
    """The entries of these categories, in list order; none for no category."""
    chosen = {named("category", c, CATEGORIES) for c in ([categories] if isinstance(categories, str) else categories)}
    return [w for w in words if w.category in chosen]


def generated(count: int) -> list[BannedWord]:
    """Made-up entries, by a rule: for tests and measures with lists of any size.

    Of ten, two are Persian words, one a phrase and one an entry that matches anywhere.
    """
    out = []
    for k in range(count):
        n = len(SYLLABLES)
        syllables = [SYLLABLES[i % n] for i in (k, k // n + 7 * k, k // (n * n) + 11 * k + 5)]
        word = "".join(syllables)
        if k % 10 in (1, 6):
            word = word.translate(str.maketrans(dict(zip("bdgkmrstvzaiu", "بدگکمرستوزایو"))))
        out.append(BannedWord(f"{word} {syllables[0]}{syllables[2]}x" if k % 10 == 3 else word, "anywhere" if k % 10 == 8 else "wholeWord", CATEGORIES[1 + k % (len(CATEGORIES) - 1)]))
    return out


#: Three of them make a word of ``generated``.
SYLLABLES = [c + v for v in "aiu" for c in "bdgkmrstvz"]


class Lists:
    """The bundled lists: those of a folder, or the starter list."""

    def __init__(self, folder: str | None = None):
        self.folder = folder or os.environ.get("TEXTWARDEN_LISTS")
        self._all: list[BannedWord] | None = None

    def all(self) -> list[BannedWord]:
        if self._all is None:
            if self.folder:
                self._all = [w for name in LIST_NAMES for w in load(os.path.join(self.folder, f"{name}.txt"))]
            else:
                self._all = parse(STARTER)
        return list(self._all)

    def default(self) -> list[BannedWord]:
        """All but the mild ones."""
        return [w for w in self.all() if w.category != "mild"]

    def bundled(self, *categories: str) -> list[BannedWord]:
        return selected(self.all(), categories)


#: Entries of the starter list.
STARTER = """\
[sexual]
کیر
کیری
~کسکش
کس کش
کسده
~kosk
kir
kos kesh
dick
cock
pussy
blowjob

[insult]
جنده
بی ناموس
حرومزاده
دیوث
jende
haroomzade
bi namoos
idiot
moron
scum
loser
bastard
whore
whores
piece of shit

[profanity]
fuck
~fuck
shit
bullshit
motherfucker
ass
asshole
bitch

[mild]
stupid
trash
damn
crap
worthless
pathetic
clown
"""

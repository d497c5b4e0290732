"""Recorded expectations: small messages with the results that any implementation has to give.

The queries run the public functions over them as tables; their SQL holds the expectations as they are
stated here, so nothing of the library stands on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions import columns as N
from textwarden.plans.guard import Guard
from textwarden.schemas import BannedWord, GuardOptions
from textwarden.sources import wordlist

# Word list, options that are off, message, matches, censored message. A match is written
# entry/evasions/start/length, evasions by their first letters: r repeated, l look-alike, s split.
MESSAGES = (
    ("damn", "", "damn", "damn//0/4", "****"),
    ("damn", "", "daaaamn", "damn/r/0/7", "****"),
    ("damn", "", "d4mn", "damn/l/0/4", "****"),
    ("damn", "", "d44aamn", "damn/rl/0/7", "****"),
    ("كثافت", "", "چه کثافتی", "", "چه کثافتی"),
    ("كثافت", "", "این کثافت", "كثافت//4/5", "این ****"),
    ("k0s", "", "ye kos inja", "k0s//3/3", "ye **** inja"),
    ("k0s", "", "ye k0s inja", "k0s//3/3", "ye **** inja"),
    ("~k0s", "", "ye kos inja", "k0s//3/3", "ye **** inja"),
    ("~k0s", "", "ye k0s inja", "k0s//3/3", "ye **** inja"),
    ("shit", "", "push it", "", "push it"),
    ("shit", "", "s h i t", "shit/s/0/7", "****"),
    ("~fuck", "", "clusterfuck", "fuck//0/11", "****"),
    ("ass", "", "classic", "", "classic"),
    ("fuck", "", "fuuuuck", "fuck/r/0/7", "****"),
    ("fuck", "squeeze", "fuuuuck", "", "fuuuuck"),
    ("fuck", "", "f*ck", "fuck/l/0/4", "****"),
    ("fuck", "fold", "f*ck", "", "f*ck"),
    ("fuck", "", "f u c k", "fuck/s/0/7", "****"),
    ("fuck", "join", "f u c k", "", "f u c k"),
    ("", "", "anything", "", "anything"),
    ("اسپم,~casino", "", "این پیام اسپم است", "اسپم//9/4", "این پیام **** است"),
    ("اسپم,~casino", "", "onlinecasino.example", "casino//0/12", "****.example"),
    ("x", "", None, "", ""),
    ("x", "", "   ", "", "   "),
    ("kir,fuck", "", "kir \U00020000 fuck", "kir//0/3;fuck//6/4", "**** \U00020000 ****"),
    ("kir", "", "kir\U00020000", "kir/l/0/4", "****"),
    ("fuck", "", "f〇ck", "fuck/l/0/4", "****"),
    ("fuck", "", "f௰ck", "fuck/l/0/4", "****"),
    ("fuck", "", "f\U00010400ck", "fuck/l/0/4", "****"),
    ("fuck", "", "f\U00020000ck!", "fuck/l/0/4", "****!"),
    ("~zzz,~yyy", "", "yyy zzz", "yyy//0/3;zzz//4/3", "**** ****"),
)
#: What first_match gives where it is not the leftmost match.
FIRST = {("~zzz,~yyy", "yyy zzz"): "zzz//4/3"}

# Steps, text, normalized text.
NORMALIZED = (
    *(("comparison", a, b) for a, b in (("ڪ", "ک"), ("ھ", "ه"), ("ە", "ه"), ("ې", "ی"), ("ٱ", "ا"), ("ﻙ", "ک"), ("بازي", "بازی"), ("كمك", "کمک"))),
    *(("comparison", a, "میروم") for a in ("می‌روم", "می​روم", "می⁠روم", "می­روم", "‫میروم‬", "مـیـروم", "مِیرُوم")),
    *(("comparison", a, "123") for a in ("۱۲۳", "١٢٣", "123")),
    ("comparison", "كتاب‌هاي  ۱۲ ABC", "کتابهای 12 abc"),
    ("standard", "كتاب‌هاي  ۱۲ ABC", "کتاب‌های ۱۲ ABC"),
    ("unifyLetters", "كتاب‌هاي", "کتاب‌های"),
    ("none", "كتاب‌هاي", "كتاب‌هاي"),
    ("comparison", "سسسسلام", "سسلام"),
    ("comparison", "BOOOOOK", "book"),
    ("comparison", "  سلام \t\n  دنیا  ", "سلام دنیا"),
    ("comparison", None, ""),
    ("comparison", "   ", ""),
    ("comparison", "ﻛﻴﺮ � BOOOK", "کیر � book"),
    ("toPersianDigits", "2 ساعت پیش، KR1", "۲ ساعت پیش، KR۱"),
    ("toAsciiDigits", "۲ ساعت پیش، KR١", "2 ساعت پیش، KR1"),
    ("toAsciiDigits", "۱۴۰۴/۰۵/۱۴", "1404/05/14"),
)

# Message, tokens joined by |.
TOKENS = (("سلام، دنیا! خوبی؟", "سلام|دنیا|خوبی"), (None, ""), ("hello,fuck", "hello|fuck"), ("کیر😂", "کیر"))

# List, entries as text/mode/category; or the line that an unknown category fails at.
LISTS = (
    ("# a comment\r\n\r\nwhole\n~anywhere\n  ~  spaced  \n", "whole/wholeWord/uncategorized;anywhere/anywhere/uncategorized;spaced/anywhere/uncategorized"),
    ("کیر\n~fuck\n", "کیر/wholeWord/uncategorized;fuck/anywhere/uncategorized"),
    ("[nonsense]\nword\n", "line 1"),
    ("[insult]\n~x\ny\n", "x/anywhere/insult;y/wholeWord/insult"),
    ("[3]\nword\n", "line 1"),
    ("[+4]\nword\n", "line 1"),
    ("[ 03 ]\nword\n", "line 1"),
    ("# list\n[ Insult ]\nword\n[SLUR]\n~other\n", "word/wholeWord/insult;other/anywhere/slur"),
)

# Bytes in hexadecimal, matches of kir and fuck as entry/start/length, first match, censored bytes.
BYTES = (
    ("6B697220FF206675636B", "kir/0/3;fuck/6/4", "kir/0/3", "2A2A2A2A20FF202A2A2A2A"),
    ("FF206B6972", "kir/2/3", "kir/2/3", "FF202A2A2A2A"),
    ("FFFE", "", None, "FFFE"),
    ("66D9802A636B20E228206B6972", "fuck/0/6;kir/10/3", "kir/10/3", "2A2A2A2A20E228202A2A2A2A"),
    (None, "", None, ""),
)

LETTERS = {"repeatedLetters": "r", "lookalikeCharacters": "l", "splitWord": "s"}


def _entries(text: str) -> list[BannedWord]:
    return [BannedWord(e.removeprefix("~"), "anywhere" if e.startswith("~") else "wholeWord") for e in text.split(",") if e]


def _written(m: Column, evasion: bool = True) -> Column:
    """A match as the recorded values write it."""
    letter = F.create_map(*[x for name, c in LETTERS.items() for x in (F.lit(name), F.lit(c))])
    kinds = [F.array_join(F.transform(m["evasion"], lambda e: letter[e]), "")] if evasion else []
    return F.concat_ws("/", m["text"], *kinds, m["index"].cast("string"), m["length"].cast("string"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """contains, first_match, matches and censor over the recorded messages, a guard for each list."""
    out = []
    for words, off in dict.fromkeys((m[0], m[1]) for m in MESSAGES):
        guard = Guard(_entries(words), GuardOptions("squeeze" not in off, "fold" not in off, "join" not in off))
        rows = spark.createDataFrame([(k, m[2]) for k, m in enumerate(MESSAGES) if m[:2] == (words, off)], "id int, text string").coalesce(1)
        found = guard.matches("text")
        out.append(rows.select("id", guard.contains("text").alias("contains"), _written(guard.first_match("text")).alias("first"), F.array_join(F.transform(found, lambda m: _written(m)), ";").alias("matches"), guard.censor("text").alias("censored"), guard.censor("text", "#").alias("censored_with")))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("first", F.when(F.col("first") != "", F.col("first")))


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Presets, single steps and the digit functions over the recorded texts, NFKC included."""
    rows = spark.createDataFrame([(k, *x[:2]) for k, x in enumerate(NORMALIZED)], "id int, steps string, text string").coalesce(1)
    makers = {"toPersianDigits": N.to_persian_digits("text"), "toAsciiDigits": N.to_ascii_digits("text")}
    chosen = [F.when(F.col("steps") == s, makers[s] if s in makers else N.normalize("text", s if s in ("comparison", "standard", "none") else [s])) for s in dict.fromkeys(x[0] for x in NORMALIZED)]
    return rows.select("id", F.coalesce(*chosen).alias("normalized"))


def tokenized(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TOKENS)], "id int, text string").coalesce(1)
    return rows.select("id", F.array_join(N.tokenize("text"), "|").alias("tokens"))


def parsed_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists that are well formed, by the table form; of the others the line of the error."""
    good = [(str(k), text) for k, (text, want) in enumerate(LISTS) if not want.startswith("line")]
    entry = F.struct("line", F.concat_ws("/", "text", "mode", "category").alias("e"))
    rows = wordlist.parse_table(spark.createDataFrame(good, "list string, content string"))
    made = rows.groupBy(F.col("list").cast("int").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    lines = []
    for k, (text, want) in enumerate(LISTS):
        if want.startswith("line"):
            try:
                wordlist.parse(text)
            except wordlist.WordListFormatError as e:
                lines.append((k, f"line {e.line}"))
    return made.select("id", F.array_join(F.transform("l", lambda x: x["e"]), ";").alias("entries")).unionByName(spark.createDataFrame(lines, "id int, entries string"))


def byte_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The five byte functions over the recorded bytes."""
    guard = Guard(_entries("kir,fuck"))
    rows = spark.createDataFrame([(k, bytes.fromhex(x[0]) if x[0] is not None else None) for k, x in enumerate(BYTES)], "id int, data binary").coalesce(1)
    matches = F.array_join(F.transform(guard.matches_bytes("data"), lambda m: _written(m, False)), ";")
    first = _written(guard.first_match_bytes("data"), False)
    return rows.select("id", guard.contains_bytes("data").alias("contains"), F.when(first != "", first).alias("first"), matches.alias("matches"), F.hex(guard.censor_bytes("data")).alias("censored"), F.hex(guard.censor_bytes("data", "#")).alias("censored_with"))


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"


def _first(m: tuple) -> str | None:
    return FIRST.get((m[0], m[2]), m[3].split(";")[0]) or None


RECORDED = {
    "recorded_messages": (messages, _values([(k, bool(m[3]), _first(m), m[3], m[4], m[4].replace("*", "#") if m[3] else m[4]) for k, m in enumerate(MESSAGES)], "id, contains, first, matches, censored, censored_with")),
    "recorded_normalization": (normalized, _values([(k, x[2]) for k, x in enumerate(NORMALIZED)], "id, normalized")),
    "recorded_tokens": (tokenized, _values([(k, x[1]) for k, x in enumerate(TOKENS)], "id, tokens")),
    "recorded_lists": (parsed_lists, _values([(k, x[1]) for k, x in enumerate(LISTS)], "id, entries")),
    "recorded_bytes": (byte_messages, _values([(k, bool(x[1]), x[2], x[1], x[3], x[3].replace("2A2A2A2A", "23232323")) for k, x in enumerate(BYTES)], "id, contains, first, matches, censored, censored_with")),
}

"""The registered queries of the guard, and their equivalents in DuckDB's SQL.

All texts of the driver's tables are in NFKC, so column queries leave NFKC out; ``nfkc_documents``
and the row-path queries take it in. The list is the starter list, a few phrases, stems and halves
that occur in the tables, and made-up entries up to the size of a full list.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.functions import charsets as C
from textwarden.functions import columns as N
from textwarden.functions.steps import character_table, resolve
from textwarden.operators import relational
from textwarden.operators.lexicon import Lexicon, compile_lexicon, surfaces
from textwarden.plans.guard import Guard
from textwarden.plans.recorded import RECORDED
from textwarden.schemas import BannedWord
from textwarden.sources import wordlist

LIST_TEXT = wordlist.STARTER + """
[harassment]
of the
and the
is the of
worthless trash
~shanth
~thereth
~bleth
thand
heon
erin
"""


#: Entries of the list that the queries use, as many as a full list has by default.
ENTRIES = 1025


#: A list that finds types of events.
EVENT_WORDS = [BannedWord("click", category="mild"), BannedWord("purchase", category="insult")]


@cache
def words() -> list[BannedWord]:
    named = wordlist.parse(LIST_TEXT)
    return named + wordlist.generated(ENTRIES - len(named))


@cache
def lexicon() -> Lexicon:
    return compile_lexicon(words())


@cache
def guard() -> Guard:
    return Guard(words())


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The table's files as a stream, be it one file or a folder of them: a stream takes a pattern for either."""
    return spark.readStream.schema(_read(spark, sf, table).schema).parquet(f"{sf}/{table}[.]parquet")


def _normal(spark: SparkSession, sf: str, table: str = "documents") -> DataFrame:
    return _read(spark, sf, table).withColumn("norm", N.normalize("text", compatibility=False))


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return relational.readings(_read(spark, sf, "documents"), "doc_id", "text", lexicon(), compatibility=False)


def _entries(spark: SparkSession) -> DataFrame:
    return lexicon().tables(spark)["entries"]


# ---- SQL pieces


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns}))"


def sql_translate(x: str, table: dict[str, str]) -> str:
    kept, gone = [c for c in table if table[c]], [c for c in table if not table[c]]
    return f"translate({x}, {quoted(''.join([*kept, *gone]))}, {quoted(''.join(table[c] for c in kept))})"


def sql_normalize(x: str, steps="comparison") -> str:
    """The steps but NFKC."""
    chosen = resolve(steps)
    out = f"coalesce({x}, '')"
    if table := character_table(chosen):
        out = sql_translate(out, table)
    if "collapseRepeats" in chosen:
        out = f"array_to_string(list_transform(list_zip([string_split({out}, '')]), lambda z: array_to_string(list_filter(z[1], lambda c, i: NOT (i > 2 AND c = z[1][i - 1] AND c = z[1][i - 2] AND NOT regexp_matches(c, '[{C.SPACE_CLASS}]') AND c <= '￿')), '')), '')"
    if "collapseWhitespace" in chosen:
        out = f"trim(regexp_replace({out}, '[{C.SPACE_CLASS}]+', ' ', 'g'))"
    return out


def sql_squeeze(x: str) -> str:
    return f"array_to_string(list_transform(list_zip([string_split({x}, '')]), lambda z: array_to_string(list_filter(z[1], lambda c, i: i = 1 OR c <> z[1][i - 1] OR c = ' ' OR c > '￿'), '')), '')"


def sql_fold(x: str) -> str:
    """Over the characters below U+2000 and the named filler, which is all that the tables hold."""
    low = lambda chars: C.java_class("".join(c for c in chars if c < "\u2000" or c in C.FILLER))
    boundary, filler = low(C.members(C.is_boundary)), low(C.members(C.is_filler))
    letters = {k: v for k, v in C.folded_letters().items() if k != v}
    digits = C.DIGIT_LETTERS
    return f"""(SELECT {sql_translate(f"""CASE WHEN regexp_matches(bare, '[{''.join(digits)}]') THEN array_to_string(list_transform(regexp_extract_all(bare, '[^{boundary}]+|[{boundary}]+'),
  lambda r: CASE WHEN regexp_matches(r, '\\p{{L}}') THEN {sql_translate('r', digits)} ELSE r END), '') ELSE bare END""", letters)} FROM (SELECT regexp_replace({x}, '[{filler}]', '', 'g') AS bare))"""


#: Vowels as look-alikes and symbols, the same in both engines: documents whose words are disguised.
DISGUISE = ("ouia", "0*1@")


def _disguised(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").withColumn("text", F.translate("text", *DISGUISE))


SQL_WORD = r"[\p{L}\p{M}\p{N}]+"
NORM = f"SELECT doc_id, {sql_normalize('text')} AS norm FROM documents"


def readings_sql(text: str = "text") -> str:
    return f"""n AS (SELECT doc_id, {sql_normalize(text)} AS norm FROM documents), n1 AS (SELECT doc_id, norm, {sql_squeeze('norm')} AS sq, {sql_fold('norm')} AS fo FROM n WHERE norm <> ''),
n2 AS (SELECT *, {sql_squeeze('fo')} AS fs FROM n1),
reads AS (SELECT doc_id, 0 AS reading, norm AS text FROM n2 UNION ALL SELECT doc_id, 1, sq FROM n2 WHERE sq <> norm UNION ALL SELECT doc_id, 2, fo FROM n2 WHERE fo <> norm AND fo <> sq
  UNION ALL SELECT doc_id, 3, fs FROM n2 WHERE fs <> norm AND fs <> sq AND fs <> fo),
toks AS (SELECT doc_id, reading, reading AS evasion, text, regexp_extract_all(text, '{SQL_WORD}') AS t FROM reads),
tok AS (SELECT doc_id, reading, evasion, unnest(t) AS key, unnest(range(0, len(t))) AS place FROM toks)"""


def hits_sql(text: str = "text") -> str:
    """hits (doc_id, reading, evasion, stage, place, key, entry_order, rank) of every stage."""
    mask = relational.MASK
    symbol, marks, letter = r"[^\p{L}\p{Nd}]", r"[\p{M}\p{Cf}]", r"\p{L}"
    folds = {k: v for k, v in (C.folded_letters() | C.DIGIT_LETTERS).items() if k not in C.SYMBOL_LETTERS}
    fits = lambda p, key: f"(length({p}) > length(translate({p}, '{mask}', '')) AND 2 * (length({p}) - length(translate({p}, '{mask}', ''))) <= length({key}) AND {key} LIKE translate({p}, '{mask}', '_'))"
    grams = lambda source: f"""(SELECT doc_id, reading, evasion, place, x || ' ' || y AS key FROM {source} WHERE y IS NOT NULL UNION ALL SELECT doc_id, reading, evasion, place, x || ' ' || y || ' ' || z FROM {source} WHERE z IS NOT NULL)"""
    near = lambda source: f"SELECT doc_id, reading, evasion, place, key AS x, lead(key) OVER w AS y, lead(key, 2) OVER w AS z FROM {source} WINDOW w AS (PARTITION BY doc_id, reading ORDER BY place)"
    inside = lambda source: f"""SELECT doc_id, reading, evasion, i - 1 AS place, key, entry_order, rank FROM (SELECT doc_id, reading, evasion, text, key, entry_order, rank, unnest(range(1, length(text) - length(key) + 2)) AS i
FROM {source} JOIN anywhere_keys ON contains(text, key)) WHERE substr(text, i, length(key)) = key"""  # noqa: E731
    return f"""{readings_sql(text)}, word_keys AS {keys_sql('surfaces')}, phrase_keys AS {keys_sql('phrases')}, anywhere_keys AS {keys_sql('anywhere')}, whole_keys AS {keys_sql('words')}, mask_keys AS {keys_sql('maskable')},
near AS ({near('tok')}),
one AS (SELECT *, regexp_matches(key, '^{letter}$') AS single FROM tok),
opened AS (SELECT *, CASE WHEN single AND coalesce(lag(single) OVER w, false) THEN 0 ELSE 1 END AS opens FROM one WINDOW w AS (PARTITION BY doc_id, reading ORDER BY place)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, reading ORDER BY place) AS run FROM opened),
merged AS (SELECT doc_id, reading, evasion, run - 1 AS place, string_agg(key, '' ORDER BY place) AS key, count(*) AS n FROM runs GROUP BY doc_id, reading, evasion, run),
joined AS (SELECT doc_id, reading, evasion + 4 AS evasion, place, key FROM merged SEMI JOIN (SELECT doc_id, reading FROM merged WHERE n > 1) x USING (doc_id, reading)),
line AS (SELECT doc_id, reading, evasion, string_agg(key, ' ' ORDER BY place) AS text FROM joined GROUP BY doc_id, reading, evasion),
joined_near AS ({near('joined')}),
pieces AS (SELECT doc_id, unnest(string_split(norm, ' ')) AS chunk, unnest(range(0, len(string_split(norm, ' ')))) AS place FROM n WHERE norm <> ''),
inner_pieces AS (SELECT doc_id, place, regexp_replace(regexp_replace(chunk, '^{symbol}+', ''), '{symbol}+$', '') AS t FROM pieces),
masked AS (SELECT doc_id, place, {sql_translate(f"regexp_replace(regexp_replace(t, '{marks}', '', 'g'), '{symbol}', '{mask}', 'g')", folds)} AS p FROM inner_pieces WHERE length(t) >= 3 AND regexp_matches(t, '{letter}')),
pattern AS (SELECT doc_id, 0 AS reading, place, p FROM masked WHERE contains(p, '{mask}')),
hits AS (SELECT doc_id, reading, evasion, 0 AS stage, place, key, entry_order, 0 AS rank FROM tok JOIN word_keys USING (key)
UNION ALL SELECT doc_id, reading, evasion, 0, place, key, entry_order, 1 + rank FROM {grams('near')} JOIN phrase_keys USING (key)
UNION ALL SELECT doc_id, reading, evasion, 1, place, key, entry_order, rank FROM ({inside('toks')})
UNION ALL SELECT doc_id, reading, evasion, 2, place, key, entry_order, 0 FROM joined JOIN word_keys USING (key)
UNION ALL SELECT doc_id, reading, evasion, 2, place, key, entry_order, 1 + rank FROM {grams('joined_near')} JOIN phrase_keys USING (key)
UNION ALL SELECT doc_id, reading, evasion, 3, place, key, entry_order, rank FROM ({inside('line')})
UNION ALL SELECT doc_id, reading, evasion + 4, 4, place, key, entry_order, rank FROM near JOIN whole_keys ON key = x || y WHERE length(x) >= 2 AND length(y) >= 2 AND regexp_matches(x || y, '^[a-z]+$')
UNION ALL SELECT doc_id, reading, 4, 5, place, key, entry_order, 0 FROM pattern JOIN word_keys ON key = translate(p, '{mask}', '') WHERE length(key) >= 3
UNION ALL SELECT doc_id, reading, 2, 5, place, key, entry_order, 1 + rank FROM pattern JOIN mask_keys ON whole AND length(p) = length(key) AND {fits('p', 'key')}
UNION ALL SELECT doc_id, reading, 2, 5, place, key, entry_order, 1 + rank FROM pattern JOIN mask_keys ON NOT whole AND length(p) >= length(key) AND len(list_filter(range(1, length(p) - length(key) + 2), lambda i: {fits('substr(p, i, length(key))', 'key')})) > 0)"""


def keys_sql(name: str) -> str:
    lex = lexicon()
    if name == "surfaces":
        return values(sorted(lex.surface.items()), "key, entry_order")
    if name == "words":
        return values([*[(k, o, 0) for k, o in lex.words.items()], *[(k, o, 1) for k, o in lex.anywhere.items()]], "key, entry_order, rank")
    if name == "anywhere":
        return values([(k, o, n) for n, (k, o) in enumerate(lex.anywhere.items())], "key, entry_order, rank")
    if name == "phrases":
        return values([(" ".join([*w[:-1], form]), len(w), o, n) for n, (w, o) in enumerate(lex.phrases) for rank, form in surfaces(w[-1]) if rank < 0 or rank % 2 == 0], "key, n, entry_order, rank")
    if name == "maskable":
        return values([(k, w, o, n) for n, (k, w, o) in enumerate(lex.maskable)], "key, whole, entry_order, rank")
    return values([(k, e.text, e.mode, e.category) for k, e in enumerate(lex.entries)], "entry_order, entry, mode, category")


# ---- queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


for _name, _steps in [(f"normalize_{p}", p) for p in ("standard", "comparison", "none")] + [(f"step_{s}", [s]) for s in ("removeDiacritics", "removeTatweel", "removeZeroWidth", "removeBidiControls", "unifyLetters", "asciiDigits", "lowerCase", "collapseRepeats", "collapseWhitespace")]:
    QUERIES[_name] = lambda s, d, steps=_steps: _read(s, d, "documents").select("doc_id", N.normalize("text", steps, compatibility=False).alias("normalized"))
    ORACLES[_name] = f"SELECT doc_id, {sql_normalize('text', _steps)} AS normalized FROM documents"


@query("SELECT doc_id, nfc_normalize(text) AS normalized FROM documents")
def nfkc_documents(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", N.nfkc("text").alias("normalized"))


@query(f"SELECT event_id, translate(props, '0123456789', '{C.PERSIAN_DIGITS}') AS persian, props AS back FROM events")
def digits_round_trip(spark, sf):
    persian = N.to_persian_digits("props")
    return _read(spark, sf, "events").select("event_id", persian.alias("persian"), N.to_ascii_digits(persian).alias("back"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(norm, '{SQL_WORD}')) AS BIGINT) AS tokens, CAST(len(list_distinct(regexp_extract_all(norm, '{SQL_WORD}'))) AS BIGINT) AS distinct_tokens FROM ({NORM})")
def token_counts(spark, sf):
    toks = N.tokenize("norm")
    return _normal(spark, sf).select("doc_id", F.size(toks).cast("long").alias("tokens"), F.size(F.array_distinct(toks)).cast("long").alias("distinct_tokens"))


@query(f"""SELECT lang, tok, n FROM (SELECT lang, tok, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS r FROM
(SELECT lang, tok, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all({sql_normalize('text')}, '{SQL_WORD}')) AS tok FROM documents) GROUP BY lang, tok)) WHERE r <= 20""")
def token_frequencies(spark, sf):
    """The 20 most frequent tokens of each language."""
    counts = _normal(spark, sf).select("lang", F.explode(N.tokenize("norm")).alias("tok")).groupBy("lang", "tok").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "tok"))).filter("r <= 20").select("lang", "tok", "n")


@query(f"""WITH s AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_extract_all(text, '{SQL_WORD}|[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS part, generate_subscripts(regexp_extract_all(text, '{SQL_WORD}|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), 1) AS seg FROM conversations),
p AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY id ORDER BY seg) AS BIGINT) AS e FROM s)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY seg) - 1 AS INTEGER) AS pos, part AS tok, e - length(part) AS start, e AS "end" FROM p WHERE regexp_matches(part, '^{SQL_WORD}$')""")
def tokens_with_offsets(spark, sf):
    turns = _read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return relational.token_table(turns, "id", "text")


@query(f"SELECT doc_id, md5({sql_squeeze('norm')}) AS squeezed, md5({sql_fold('norm')}) AS folded FROM ({NORM})")
def squeeze_and_fold(spark, sf):
    return _normal(spark, sf).select("doc_id", F.md5(N.squeeze("norm")).alias("squeezed"), F.md5(N.fold("norm")).alias("folded"))


@query(f"WITH {readings_sql()} SELECT doc_id, CAST(count(*) AS BIGINT) AS readings, CAST(sum(reading) AS BIGINT) AS kinds FROM reads GROUP BY doc_id")
def readings_distinct(spark, sf):
    return _reads(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("readings"), F.sum("reading").alias("kinds"))


PARSED = "SELECT line, text, mode, category FROM " + values([(n, e.text, e.mode, e.category) for n, e in zip([k + 1 for k, x in enumerate(LIST_TEXT.split("\n")) if x and not x.startswith("[")], wordlist.parse(LIST_TEXT))], "line, text, mode, category")


@query(PARSED)
def wordlist_parse(spark, sf):
    content = spark.createDataFrame([("own", LIST_TEXT)], "list string, content string")
    return wordlist.parse_table(content).select("line", "text", "mode", "category")


@query(f"""SELECT category, count(*) AS entries, count(*) FILTER (mode = 'anywhere') AS anywhere, array_to_string((list(entry ORDER BY entry_order))[:5], '|') AS first, array_to_string((list(entry ORDER BY entry_order))[-5:], '|') AS last,
count(DISTINCT struct_pack(e := entry, m := mode)) = count(*) AS "distinct", true AS filled FROM {keys_sql('entries')} GROUP BY category""")
def category_profile(spark, sf):
    found = wordlist.profile(wordlist.as_table(spark, lexicon().entries))
    return found.withColumns({"first": F.array_join("first", "|"), "last": F.array_join("last", "|")})


@query(f"SELECT DISTINCT entry FROM {keys_sql('entries')} WHERE category IN ('insult', 'mild') AND entry NOT IN (SELECT entry FROM {keys_sql('entries')} WHERE category = 'mild')")
def bundled_select(spark, sf):
    """Selection by category, and the difference of two selections."""
    chosen, mild = (wordlist.as_table(spark, wordlist.selected(words(), c)).select(F.col("text").alias("entry")) for c in (("insult", "mild"), ("mild",)))
    return chosen.exceptAll(mild).distinct()


@query(f"SELECT 'own' AS list, entry_order, entry AS text, mode, category FROM {keys_sql('entries')} UNION ALL SELECT 'events', {ENTRIES} + k, t, 'wholeWord', c FROM (VALUES (0, 'click', 'mild'), (1, 'purchase', 'insult')) AS v(k, t, c)")
def concatenated_lists(spark, sf):
    return wordlist.concatenated(wordlist.as_table(spark, words(), "own"), wordlist.as_table(spark, EVENT_WORDS, "events"))


@query(f"SELECT key, CAST(entry_order AS INTEGER) AS entry_order FROM {keys_sql('surfaces')}")
def suffix_expansion(spark, sf):
    """Keys joined with the suffix table by the rules, the least rank of each form kept."""
    keys = spark.createDataFrame(list(lexicon().words.items()), "word string, entry_order int")
    suffixes = spark.createDataFrame(list(enumerate(C.PERSIAN_SUFFIXES)), "k int, suffix string")
    persian = keys.filter(F.col("word").rlike(r"^[\x{600}-\x{6FF}&&\p{L}]"))
    least = F.when(F.length("suffix") == 1, 4).otherwise(3)
    plain = persian.join(F.broadcast(suffixes), F.length("word") >= least).select(F.concat("word", "suffix").alias("key"), "entry_order", (F.col("k") * 2).alias("rank"))
    heh = persian.filter(F.endswith("word", F.lit(C.HEH))).join(F.broadcast(suffixes.filter(F.startswith("suffix", F.lit(C.HEH_SUFFIX_START)))), F.length("word") - 1 >= least)
    heh = heh.select(F.concat(F.expr("substring(word, 1, length(word) - 1)"), F.col("suffix")).alias("key"), "entry_order", (F.col("k") * 2 + 1).alias("rank"))
    every = keys.select(F.col("word").alias("key"), "entry_order", F.lit(-1).alias("rank")).unionByName(plain).unionByName(heh)
    return every.groupBy("key").agg(F.min_by("entry_order", F.struct("rank", "entry_order")).alias("entry_order"))


@query(f"WITH {readings_sql()} SELECT doc_id, reading, place, key, entry_order FROM tok JOIN {keys_sql('surfaces')} USING (key)")
def word_hits(spark, sf):
    return relational.word_hits(_read(spark, sf, "documents"), "doc_id", "text", lexicon(), compatibility=False).select("doc_id", "reading", "place", "key", "entry_order")


@query(f"""WITH {readings_sql()}, a AS (SELECT doc_id, reading, place, key AS x, lead(key) OVER w AS y, lead(key, 2) OVER w AS z FROM tok WINDOW w AS (PARTITION BY doc_id, reading ORDER BY place)),
g AS (SELECT doc_id, reading, place, x || ' ' || y AS key FROM a WHERE y IS NOT NULL UNION ALL SELECT doc_id, reading, place, x || ' ' || y || ' ' || z FROM a WHERE z IS NOT NULL)
SELECT doc_id, reading, place, key, entry_order FROM g JOIN {keys_sql('phrases')} USING (key)""")
def phrase_hits(spark, sf):
    return relational.phrase_hits(_read(spark, sf, "documents"), "doc_id", "text", lexicon(), compatibility=False).select("doc_id", "reading", "place", "key", "entry_order")


@query(f"""WITH {readings_sql()} SELECT doc_id, reading, i - 1 AS place, key, entry_order FROM (SELECT doc_id, reading, text, key, entry_order, unnest(range(1, length(text) - length(key) + 2)) AS i
FROM reads JOIN {keys_sql('anywhere')} ON contains(text, key)) WHERE substr(text, i, length(key)) = key""")
def anywhere_hits(spark, sf):
    return relational.anywhere_hits(_read(spark, sf, "documents"), "doc_id", "text", lexicon(), compatibility=False).select("doc_id", "reading", "place", "key", "entry_order")


@query(f"""WITH {readings_sql()}, o AS (SELECT *, length(key) = 1 AND regexp_matches(key, '^\\p{{L}}$') AS one FROM tok),
r AS (SELECT *, CASE WHEN one AND coalesce(lag(one) OVER w, false) THEN 0 ELSE 1 END AS opens FROM o WINDOW w AS (PARTITION BY doc_id, reading ORDER BY place)),
q AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, reading ORDER BY place) AS run FROM r)
SELECT doc_id, reading, min(place) AS place, string_agg(key, '' ORDER BY place) AS key, count(*) AS letters FROM q GROUP BY doc_id, reading, run HAVING count(*) > 1""")
def joined_single_letters(spark, sf):
    return relational.joined_tokens(_read(spark, sf, "documents"), "doc_id", "text", lexicon(), compatibility=False).select("doc_id", "reading", F.col("place").cast("long").alias("place"), "key", "letters")


@query(f"""WITH {readings_sql()}, p AS (SELECT doc_id, reading, place, key AS a, lead(key) OVER (PARTITION BY doc_id, reading ORDER BY place) AS b FROM tok)
SELECT doc_id, reading, place, a || b AS key, entry_order FROM p JOIN {keys_sql('words')} ON key = a || b WHERE length(a) >= 2 AND length(b) >= 2 AND regexp_matches(a || b, '^[a-z]+$')""")
def split_halves(spark, sf):
    return relational.split_hits(_read(spark, sf, "documents"), "doc_id", "text", lexicon(), compatibility=False).select("doc_id", "reading", "place", "key", "entry_order")


DISGUISED = f"translate(text, '{DISGUISE[0]}', '{DISGUISE[1]}')"


@query(f"WITH {hits_sql(DISGUISED)} SELECT doc_id, count(*) AS chunks FROM pattern GROUP BY doc_id")
def broken_chunks(spark, sf):
    return relational.patterns(_disguised(spark, sf), "doc_id", "text", lexicon(), compatibility=False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query(f"WITH {hits_sql(DISGUISED)} SELECT doc_id, CAST(place AS BIGINT) AS place, key, evasion, entry_order FROM hits WHERE stage = 5")
def chunk_hits(spark, sf):
    """Chunks of disguised documents, with symbols taken out and standing for letters."""
    return relational.chunk_hits(_disguised(spark, sf), "doc_id", "text", lexicon(), compatibility=False).select("doc_id", "place", "key", "evasion", "entry_order")


DIRECT = f"WITH {hits_sql()}"


@query(DIRECT + " SELECT d.doc_id, lang FROM documents d SEMI JOIN hits ON d.doc_id = hits.doc_id")
def flagged_documents(spark, sf):
    return guard().flagged(_read(spark, sf, "documents"), "doc_id", "text").select("doc_id", "lang")


@query(DIRECT + " SELECT d.doc_id, lang FROM documents d ANTI JOIN hits ON d.doc_id = hits.doc_id")
def clean_documents(spark, sf):
    return guard().clean(_read(spark, sf, "documents"), "doc_id", "text").select("doc_id", "lang")


@query(DIRECT + f"""SELECT lang, category, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, entry_order FROM hits) h JOIN {keys_sql('entries')} USING (entry_order)
JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, category)""")
def hits_by_category(spark, sf):
    """Hits of every stage."""
    named = guard().hit_table(_read(spark, sf, "documents"), "doc_id", "text").join(F.broadcast(_entries(spark).select("entry_order", "category")), "entry_order")
    return named.join(_read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").rollup("lang", "category").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("documents"))


@query(DIRECT + f"""SELECT lang, category, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, entry_order FROM tok JOIN word_keys USING (key) WHERE reading = 0) h JOIN {keys_sql('entries')} USING (entry_order)
JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, category)""")
def words_by_category(spark, sf):
    """Undisguised whole words; only the normalized reading is made."""
    named = relational.word_hits(_read(spark, sf, "documents"), "doc_id", "text", lexicon(), compatibility=False, only=0).join(F.broadcast(_entries(spark).select("entry_order", "category")), "entry_order")
    return named.join(_read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").rollup("lang", "category").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("documents"))


@query(DIRECT + """SELECT toxic, flagged, count(*) AS documents FROM (SELECT l.doc_id, toxic, l.doc_id IN (SELECT doc_id FROM hits) AS flagged FROM labels l) GROUP BY toxic, flagged""")
def hits_against_labels(spark, sf):
    found = guard().hit_table(_read(spark, sf, "documents"), "doc_id", "text").select("doc_id").distinct().withColumn("hit", F.lit(True))
    joined = _read(spark, sf, "labels").join(found, "doc_id", "left").select("toxic", F.coalesce("hit", F.lit(False)).alias("flagged"))
    return joined.groupBy("toxic", "flagged").agg(F.count(F.lit(1)).alias("documents"))


@query(f"""WITH {hits_sql(DISGUISED)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN stage = 5 THEN 4 ELSE reading END, stage,
CASE WHEN stage IN (1, 3) THEN rank ELSE place END, CASE WHEN stage IN (1, 3) THEN place ELSE rank END, entry_order) AS k FROM hits)
SELECT doc_id, reading, evasion, stage, CAST(place AS BIGINT) AS place, key, entry_order FROM r WHERE k = 1""")
def first_hit(spark, sf):
    """Of every stage, the hit that the least evasion undone brings, over disguised documents."""
    return relational.first_hits(guard().hit_table(_disguised(spark, sf), "doc_id", "text"), "doc_id")


REGIONS = """WITH c AS (SELECT l_orderkey AS id, CAST(l_partkey % 97 AS BIGINT) AS s, CAST(l_partkey % 97 + 1 + l_quantity AS BIGINT) AS e, CAST(l_linenumber AS INTEGER) AS o, CAST(l_suppkey % 8 AS INTEGER) AS v FROM lineitem),
w AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e DESC, o ROWS UNBOUNDED PRECEDING) AS island FROM w),
b AS (SELECT id, island, min(s) AS start, max(e) AS "end", arg_max(o, struct_pack(l := e - s, o := -o)) AS entry_order FROM i GROUP BY id, island)
SELECT b.id, b.start, b."end", b.entry_order, (SELECT min(v) FROM i WHERE i.id = b.id AND i.island = b.island AND i.o = b.entry_order) AS evasion FROM b"""


@query(REGIONS)
def merge_regions(spark, sf):
    """Interval islands over order lines, as candidates of matches."""
    lines = _read(spark, sf, "lineitem")
    start = F.col("l_partkey") % 97
    end = F.rint(start + 1 + F.col("l_quantity")).cast("long")  # SQL's cast rounds, Spark's cuts
    candidates = lines.select(F.col("l_orderkey").alias("id"), start.alias("start"), end.alias("end"), (end - start).alias("hit_length"), F.col("l_linenumber").cast("int").alias("entry_order"), (F.col("l_suppkey") % 8).cast("int").alias("evasion"))
    return relational.merge_regions(candidates, "id")


@query(f"WITH {hits_sql(DISGUISED)} SELECT doc_id, stage, count(*) AS hits, CAST(sum(place) AS BIGINT) AS places, CAST(sum(evasion) AS BIGINT) AS evasions, CAST(sum(entry_order) AS BIGINT) AS entries FROM hits GROUP BY doc_id, stage")
def all_hits(spark, sf):
    """Every stage of the relational path, over disguised documents."""
    found = relational.hits(_disguised(spark, sf), "doc_id", "text", lexicon())
    return found.groupBy("doc_id", "stage").agg(F.count(F.lit(1)).alias("hits"), F.sum("place").alias("places"), F.sum("evasion").alias("evasions"), F.sum("entry_order").alias("entries"))


@query(DIRECT + " SELECT doc_id, doc_id IN (SELECT doc_id FROM hits) AS contains FROM documents")
def contains_documents(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", guard().contains("text").alias("contains"))


@query(f"""WITH {hits_sql(DISGUISED)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN stage = 5 THEN 4 ELSE reading END, stage,
CASE WHEN stage IN (1, 3) THEN rank ELSE place END, CASE WHEN stage IN (1, 3) THEN place ELSE rank END, entry_order) AS k FROM hits)
SELECT doc_id, entry, category, evasion FROM r JOIN {keys_sql('entries')} USING (entry_order) WHERE k = 1""")
def first_match_entries(spark, sf):
    """What first_match reports, by the row path, over disguised documents; evasion as bits."""
    m = F.col("m")
    bits = F.aggregate("m.evasion", F.lit(0), lambda a, e: a + F.when(e == "repeatedLetters", 1).when(e == "lookalikeCharacters", 2).otherwise(4))
    found = guard().first_table(_disguised(spark, sf), "text", "doc_id")
    return found.select("doc_id", m["text"].alias("entry"), m["category"].alias("category"), bits.alias("evasion"))


@query()
def first_matches(spark, sf):
    found = guard().first_table(_read(spark, sf, "documents"), "text", "doc_id")
    return found.select("doc_id", "m.text", "m.category", F.array_join("m.evasion", ",").alias("evasion"), "m.index", "m.length")


@query()
def match_positions(spark, sf):
    found = guard().match_table(_read(spark, sf, "documents"), "text", "doc_id")
    return found.withColumn("evasion", F.array_join("evasion", ","))


@query()
def censored_documents(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", guard().censor("text").alias("censored"))


@query()
def censored_conversations(spark, sf):
    return _read(spark, sf, "conversations").select("conv_id", "turn", guard().censor("text", "#").alias("censored"))


@query()
def byte_matches(spark, sf):
    """Turns as bytes, with bytes in front that are no UTF-8."""
    turns = _read(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.unhex(F.lit("FF20")), F.col("text").cast("binary")).alias("data"))
    found = turns.select("conv_id", "turn", F.explode(guard().matches_bytes("data")).alias("m"))
    return found.select("conv_id", "turn", "m.text", "m.index", "m.length")


@query("SELECT conv_id, turn, count(*) AS messages FROM conversations GROUP BY conv_id, turn")
def message_stream(spark, sf):
    """A bounded run of the streaming path: turns as a stream, censored, into a table of files."""
    from textwarden.streaming.reports import censored

    base = f"{work_folder(spark)}/textwarden-stream-{uuid.uuid4().hex}"
    source = _stream(spark, sf, "conversations")
    running = censored(source, guard(), "text").writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/rows")
    running.awaitTermination()
    return spark.read.parquet(f"{base}/rows").filter("censored IS NOT NULL").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("messages"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end,
CASE event_type WHEN 'click' THEN 'mild' ELSE 'insult' END AS category, count(*) AS matches FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL""")
def stream_match_counts(spark, sf):
    """A bounded run of windowed counts: events as a stream, what a small list finds in their types."""
    from textwarden.streaming.reports import match_counts

    base = f"{work_folder(spark)}/textwarden-stream-{uuid.uuid4().hex}"
    source = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = match_counts(source, Guard(EVENT_WORDS), "event_type", "ts", "6 hours", "1 hour")
    # each run of the counts replaces the table, so the last is the whole
    replace = lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/rows")
    running = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{base}/rows").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='textwarden-')}"


for _name, (_run, _sql) in RECORDED.items():
    QUERIES[_name], ORACLES[_name] = _run, _sql


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged documents per language and category."""
    return words_by_category(spark, sf)

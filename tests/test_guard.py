"""Row path, relational path and word lists, on small cases written out here.

The cases of a folder in the common JSON format run too where TEXTWARDEN_CASES names it, with the
full lists of TEXTWARDEN_LISTS.
"""

import glob
import io
import json
import os
import random

import pytest

from textwarden.functions import columns as N
from textwarden.functions import rowtext as T
from textwarden.operators import relational, rowmatch
from textwarden.operators.lexicon import compile_lexicon
from textwarden.plans.guard import Guard, matched_text, register
from textwarden.plans.queries import LIST_TEXT
from textwarden.schemas import BannedWord, GuardOptions, WordListFormatError
from textwarden.sources import wordlist


def one(*words, **options):
    return compile_lexicon([w if isinstance(w, BannedWord) else BannedWord(w) for w in words], GuardOptions(**options))


def spans(lexicon, text):
    return [(m["index"], m["length"], m["evasion"]) for m in rowmatch.matches(lexicon, text)]


REPEATED, LOOKALIKE, SPLIT = "repeatedLetters", "lookalikeCharacters", "splitWord"


@pytest.mark.parametrize(
    "words,text,want",
    [
        (["damn"], "daaaamn", [(0, 7, [REPEATED])]),
        (["damn"], "d4mn", [(0, 4, [LOOKALIKE])]),
        (["damn"], "d44aamn", [(0, 7, [REPEATED, LOOKALIKE])]),
        (["shit"], "push it", []),
        (["shit"], "s h i t", [(0, 7, [SPLIT])]),
        (["kir"], "kir" + chr(0x20000), [(0, 4, [LOOKALIKE])]),
        ([BannedWord("fuck", "anywhere")], "clusterfuck", [(0, 11, [])]),
        (["fuck"], "f*ck", [(0, 4, [LOOKALIKE])]),
        *((["fuck"], f"f{c}ck", [(0, 4, [LOOKALIKE])]) for c in "〇௰௲\U00010400\U00020000"),
        (["fuck"], "fu ck", [(0, 5, [SPLIT])]),
        (["fuck"], "fuc k", []),
        (["asshole"], "a$$hole", [(0, 7, [LOOKALIKE])]),
        (["455"], "455", [(0, 3, [])]),
        (["ass"], "455", []),
        (["ass"], "4ss", [(0, 3, [LOOKALIKE])]),
        (["جنده"], "جندها", [(0, 5, [])]),
        (["جنده"], "ج.نده", [(0, 5, [SPLIT])]),
        (["کیر"], "کیرا", []),
        (["کیر"], "کیرتون", [(0, 6, [])]),
        (["کیر"], "کی ر", [(0, 4, [SPLIT])]),
        (["بی ناموس"], "بی ناموس‌ها", [(0, 11, [])]),
        (["motherfucker", "fuck"], "motherfucker fuck", [(0, 12, []), (13, 4, [])]),
        (["fuck"], None, []),
        (["fuck"], " \n", []),
    ],
)
def test_matches(words, text, want):
    lexicon = one(*words)
    assert spans(lexicon, text) == want
    assert rowmatch.contains(lexicon, text) == bool(want)


@pytest.mark.parametrize("off,text", [("squeeze_repeated_letters", "fuuuuck"), ("fold_lookalike_characters", "f*ck"), ("join_spaced_letters", "f u c k")])
def test_options(off, text):
    assert rowmatch.contains(one("fuck"), text)
    assert not rowmatch.contains(one("fuck", **{off: False}), text)
    with pytest.raises(TypeError):
        GuardOptions(**{off: 1})


def test_censoring_goes_on_until_clean():
    lexicon = compile_lexicon(wordlist.parse("kos\nkir"))
    out = rowmatch.censor(lexicon, "k kos i kos r")
    assert "kos" not in out and not rowmatch.contains(lexicon, out)
    assert rowmatch.censor(lexicon, None) == "" and rowmatch.censor(lexicon, "fine") == "fine"
    assert rowmatch.censor_bytes(compile_lexicon(wordlist.parse("kir\nfuck")), b"kir \xff fuck") == b"**** \xff ****"
    assert [(m["index"], m["length"]) for m in rowmatch.matches_bytes(compile_lexicon(wordlist.parse("kir\nfuck")), b"kir \xff fuck")] == [(0, 3), (6, 4)]
    for mask in ("", "**", "a", "1", " ", "\0", chr(0x1F600)):
        with pytest.raises(ValueError):
            rowmatch.censor(lexicon, "x", mask)
    with pytest.raises(TypeError):
        rowmatch.censor(lexicon, "x", 5)


def noise(seed, n=300):
    """Messages of runs of characters, weighted towards letters of listed words."""
    rng = random.Random(seed)
    kinds = [("کیرجندهوسا", 6), ("fuckshitkosa", 6), ("‌‍­‏ـً", 2), ("0134578۱۲", 2), ("!@$*.-_|€ ", 4), (" ", 4), ("ǅÄéİßøſ", 1), ("\U0001F170\U0001F600\U00020000", 1), ("َ́︎", 1), ("укеo﷐", 1)]
    for _ in range(n):
        out = ""
        for _ in range(rng.randint(0, 30)):
            if rng.random() < 0.03:
                out += rng.choice([" ", ""]) + rng.choice(["fuck", "کیر", "idi0t", "f〇ck", "sh௰t", "f\U00010400ck", "\U00020000fu\U00020000k", "a\U0001F600x", "s.h.i.t", "f u c k", "جنده‌ها", "kos kesh", "piece of shit"]) + rng.choice([" ", ""])
            chars = rng.choices([k for k, _ in kinds], [w for _, w in kinds])[0]
            out += rng.choice(chars) * rng.choices([1, rng.randint(2, 5), rng.randint(6, 39)], [8, 1, 1])[0]
        yield out


def test_invariants():
    lexicon = compile_lexicon(wordlist.parse(LIST_TEXT))
    dirty = 0
    for text in noise(1):
        found, first, out = rowmatch.matches(lexicon, text), rowmatch.first_match(lexicon, text), rowmatch.censor(lexicon, text)
        assert rowmatch.contains(lexicon, text) == bool(found) == (first is not None) == (out != text)
        assert not rowmatch.contains(lexicon, out)
        ends = [0]
        for m in found:
            assert m["index"] >= ends[-1] and m["length"] >= 1
            ends.append(m["index"] + m["length"])
        assert ends[-1] <= len(text)
        dirty += bool(found)
    assert dirty > 20


def test_column_functions_equal_row_functions(spark):
    texts = [*noise(2), None, "", "كتاب‌هاي  ۱۲ ABC", "سلام، دنیا! خوبی؟", "x_y a‌b ‌c", "ﬁ ½ é", "aaa   bbb  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for steps in ("comparison", "standard", "none", ["lowerCase"], ["collapseRepeats"], ["unifyLetters", "asciiDigits"]):
        got = {r.id: r.n for r in N.normalize_table(df, "text", "n", steps).collect()}
        assert got == {i: T.normalize(t, steps) for i, t in enumerate(texts)}
    norm = N.normalize_table(df, "text", "n")
    got = {r.id: (r.t, r.s, r.f) for r in norm.select("id", N.tokenize("n").alias("t"), N.squeeze("n").alias("s"), N.fold("n").alias("f")).collect()}
    for i, t in enumerate(texts):
        n = T.normalize(t)
        assert got[i] == ([w for w, _, _ in T.tokens(n)], T.squeeze(n), T.fold(n)), ascii(n)
    rows = relational.token_table(df, "id", "text").orderBy("id", "pos").collect()
    want = [(i, k, *w) for i, t in enumerate(texts) for k, w in enumerate(T.tokens(t or ""))]
    assert [(r.id, r.pos, r.tok, r.start, r.end) for r in rows] == want
    digits = df.filter("id < 3").select(N.to_persian_digits("text").alias("p")).collect()
    assert [r.p for r in digits] == [T.to_persian_digits(t) for t in texts[:3]]


def test_traces_are_the_reading_and_go_forward():
    from textwarden.functions.rowtext import traced

    for text in noise(3):
        trace = traced(text)
        assert trace.text == T.normalize(text)
        for t, plain in ((trace, trace.text), (trace.squeezed(), T.squeeze(trace.text)), (trace.folded(), T.fold(trace.text)), (trace.folded().squeezed(), T.squeeze(T.fold(trace.text)))):
            assert t.text == plain and len(t.first) == len(t.last) == len(plain)
            assert list(t.first) == sorted(t.first) and all(a <= b < len(text) for a, b in zip(t.first, t.last))


def test_paths_agree(spark, sf_dir):
    guard = Guard(wordlist.parse(LIST_TEXT))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = list(enumerate([t for t in noise(4, 200)], 10**6))
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    row = {r.doc_id for r in both.filter(guard.contains("text")).select("doc_id").collect()}
    found = guard.hit_table(both, "doc_id", "text")
    joined = {r.doc_id: (r.entry_order, r.evasion) for r in relational.first_hits(found, "doc_id").collect()}
    assert joined.keys() == row
    first = {}
    for r in both.collect():
        hit = next(rowmatch.Message(guard.lexicon, r.text or "").hits(), None)
        if hit:
            first[r.doc_id] = (hit.order, hit.evasion)
    assert joined == first
    assert guard.flagged(docs, "doc_id", "text").count() + guard.clean(docs, "doc_id", "text").count() == docs.count()


def test_regions_by_window(spark):
    lexicon = compile_lexicon(wordlist.parse(LIST_TEXT))
    rows, want = [], []
    for i, text in enumerate(noise(5)):
        message = rowmatch.Message(lexicon, text)
        for h in message.hits():
            start, end, length = message.placed(h)
            rows.append((i, start, end, length, h.order, h.evasion))
        want += [(i, r.start, r.end, r.order, r.evasion) for r in message.regions()]
    df = spark.createDataFrame(rows, "id long, start long, end long, hit_length long, entry_order int, evasion int")
    got = relational.merge_regions(df, "id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_word_lists(spark, tmp_path):
    text = "﻿# list\n[ Insult ]\r\nword\n[SLUR]\n~other\n~ \n two words \n"
    want = [("word", "wholeWord", "insult"), ("other", "anywhere", "slur"), ("two words", "wholeWord", "slur")]
    as_rows = lambda words: [(w.text, w.mode, w.category) for w in words]
    path = tmp_path / "list.txt"
    path.write_bytes(text.encode())
    assert as_rows(wordlist.load(path)) == as_rows(wordlist.load(io.BytesIO(text.encode()))) == want
    assert [tuple(r)[2:] for r in wordlist.load_table(spark, str(path)).orderBy("line").collect()] == want
    with pytest.raises(WordListFormatError, match="Line 2: unknown word category '3'") as e:
        wordlist.parse("a\n[3]")
    assert e.value.line == 2
    with pytest.raises(Exception, match="Line 2: unknown word category '3'"):
        wordlist.parse_table(spark.createDataFrame([("l", "a\n[3]")], "list string, content string")).collect()
    path.write_bytes(b"\xff")
    with pytest.raises(UnicodeDecodeError, match="list.txt"):
        wordlist.load(path)
    with pytest.raises(FileNotFoundError):
        wordlist.load(tmp_path / "none.txt")
    lists = wordlist.Lists()
    assert len(lists.default()) == len(lists.all()) - len(lists.bundled("mild")) and lists.bundled() == []
    with pytest.raises(ValueError):
        lists.bundled("nothing")


def test_lexicon():
    lexicon = one("a b", "A  B", "word", BannedWord("word", "anywhere"), " ", "!!", "w0rd")
    assert lexicon.count == 5 and lexicon.words["word"] == 2
    for bad in (None, "text", 5, ["text"]):
        with pytest.raises(TypeError):
            compile_lexicon(bad)
    with pytest.raises(ValueError):
        BannedWord("x", "someMode")
    with pytest.raises(ValueError):
        T.normalize("x", "lowerCase")
    with pytest.raises(ValueError):
        T.normalize("x", ["nothing"])


def test_guard_columns_sql_and_stream(spark, tmp_path):
    guard = Guard(wordlist.parse(LIST_TEXT))
    df = spark.createDataFrame([(1, "you f*ck"), (2, None), (3, "fine")], "id long, text string")
    got = df.select("id", guard.contains("text").alias("c"), guard.first_match("text").alias("f"), guard.matches("text").alias("m"), guard.censor("text", "#").alias("x"), guard.contains_bytes(df.text.cast("binary")).alias("b")).orderBy("id").collect()
    assert [r.c for r in got] == [r.b for r in got] == [True, False, False]
    assert [r.x for r in got] == ["you ####", "", "fine"] and got[1].f is None and got[1].m == []
    assert (got[0].f.text, got[0].f.evasion, got[0].m[0]["index"]) == ("fuck", [LOOKALIKE], 4)
    part = df.filter("id = 1").select(guard.first_match("text").alias("f"), "text")
    assert part.select(matched_text("text", part.f).alias("p")).first().p == "f*ck"
    register(spark, guard)
    df.createOrReplaceTempView("messages")
    row = spark.sql("SELECT guard_contains(text) c, guard_normalize(text, 'comparison') n, guard_tokenize(text) t, size(guard_matches(text)) m, guard_censor(text) x FROM messages WHERE id = 1").first()
    assert tuple(row) == (True, "you f*ck", ["you", "f", "ck"], 1, "you ****")
    assert spark.sql("SELECT id, r.text FROM messages, LATERAL guard_match_rows(messages.text) r").collect() == [(1, "fuck")]

    from textwarden.streaming.reports import match_counts

    timed = spark.createDataFrame([("fuck idiot", "2024-01-01 00:01:00"), ("fuck", "2024-01-01 00:07:00"), ("fine", "2024-01-01 02:00:00")], "text string, ts string").selectExpr("text", "cast(ts AS timestamp) AS ts")
    timed.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
    running = match_counts(stream, guard, "text", "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    assert sorted((r.category, r.matches) for r in spark.table("counts").collect()) == [("insult", 1), ("profanity", 1), ("profanity", 1)]


def test_first_in_anywhere_stages_is_by_list(spark):
    guard = Guard([BannedWord("zab", "anywhere"), BannedWord("yab", "anywhere")])
    df = spark.createDataFrame([(1, "yab zab"), (2, "y a b z a b")], "id long, text string")
    got = relational.first_hits(guard.hit_table(df, "id", "text"), "id").orderBy("id").collect()
    assert [r.key for r in got] == ["zab"] * 2 == [rowmatch.first_match(guard.lexicon, t)["text"] for t in ("yab zab", "y a b z a b")]


def test_long_lists_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(relational, "BROADCAST_KEYS", 0)
    guard = Guard(wordlist.parse(LIST_TEXT))
    df = spark.createDataFrame([(1, "you f*ck"), (2, None), (3, "fine")], "id long, text string")
    assert [r.id for r in guard.flagged(df, "id", "text").collect()] == [1]


def built(value, lone=lambda code: "�"):
    if isinstance(value, dict) and "build" in value:
        return "".join(p["text"] if "text" in p else p["repeat"] * p["times"] if "repeat" in p else lone(int(p["utf16"], 16)) for p in value["build"])
    return value


@pytest.mark.skipif("TEXTWARDEN_CASES" not in os.environ, reason="no folder of cases is named")
def test_cases_of_a_folder():
    folder, lists = os.environ["TEXTWARDEN_CASES"], wordlist.Lists()
    with open(f"{folder}/configurations.json") as f:
        named = json.load(f)
    lexicons = {}
    for c in named["configurations"] if isinstance(named, dict) else named:
        chosen = c["wordLists"].get("bundled") or []
        words = lists.default() if chosen == "default" else lists.all() if chosen == "all" else lists.bundled(*chosen)
        words += [BannedWord(e["text"], e.get("mode", "wholeWord"), e.get("category", "uncategorized")) for e in c["wordLists"].get("entries") or []]
        o = c.get("options") or {}
        lexicons[c["name"]] = compile_lexicon(words, GuardOptions(o.get("squeezeRepeatedLetters", True), o.get("foldLookalikeCharacters", True), o.get("joinSpacedLetters", True)))
    as_entry = lambda w: {"text": w.text, "mode": w.mode, "category": w.category}
    as_match = lambda m: m and {"entry": {k: m[k] for k in ("text", "mode", "category")}, "evasion": m["evasion"], "start": m["index"], "length": m["length"]}
    seen = 0
    for path in sorted(glob.glob(f"{folder}/cases/*.json")):
        with open(path) as f:
            cases = json.load(f)
        for c in cases:
            want = c["expected"]
            if c["kind"] in ("must-match", "ordinary", "robustness"):
                lexicon, text = lexicons[c["configuration"]], built(c["input"])
                got = (rowmatch.contains(lexicon, text), as_match(rowmatch.first_match(lexicon, text)), [as_match(m) for m in rowmatch.matches(lexicon, text)], rowmatch.censor(lexicon, text))
                assert got == (want["containsProfanity"], want.get("firstMatch"), want["matches"], built(want["censored"])), c["id"]
                for mask, out in (want.get("censoredWith") or {}).items():
                    assert rowmatch.censor(lexicon, text, mask) == built(out), c["id"]
            elif c["kind"] == "normalization":
                text, steps = built(c["input"]), c["steps"]
                got = T.to_persian_digits(text) if steps == "toPersianDigits" else T.to_ascii_digits(text) if steps == "toAsciiDigits" else T.normalize(text, steps)
                assert got == built(want["output"] if isinstance(want, dict) else want), c["id"]
            elif c["kind"] == "tokenization":
                assert [w for w, _, _ in T.tokens(built(c["input"]) or "")] == want["tokens"], c["id"]
            elif c["kind"] == "word-list-parsing":
                try:
                    assert [as_entry(w) for w in wordlist.parse(built(c["text"]))] == want["entries"], c["id"]
                except WordListFormatError as e:
                    assert e.line == want["error"]["line"], c["id"]
            elif c["kind"] == "category-selection":
                chosen = c["selection"]
                words = lists.default() if chosen == "default" else lists.all() if chosen == "all" else lists.bundled(*chosen)
                assert (len(words), [as_entry(w) for w in words[:5]], [as_entry(w) for w in words[-5:]]) == (want["count"], want["first"], want["last"]), c["id"]
            elif c["kind"] == "mask-validation":
                try:
                    accepted = bool(rowmatch.validate_mask(built(c["mask"], chr)))
                except ValueError:
                    accepted = False
                assert accepted == want["accepted"], c["id"]
            else:
                raise AssertionError(f"unknown kind {c['kind']}")
            seen += 1
    assert seen > 100

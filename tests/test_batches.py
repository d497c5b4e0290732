"""Many texts at once: the same as one by one, each word and chunk looked at once, each text read once."""

import io
from contextlib import redirect_stdout

import pytest

from textwarden.functions import batchtext as B
from textwarden.functions import rowtext as T
from textwarden.functions.steps import COMPARISON
from textwarden.operators import relational, wordfind
from textwarden.operators.lexicon import compile_lexicon
from textwarden.plans.queries import LIST_TEXT
from textwarden.sources import wordlist

from test_guard import noise

ODD = ["", "\0\0a\0\0", "b\U0010ffffb  ", "  ", "\0", "a‌‍b", "1‌2", " x  ", "a" * (B.SLICE + 5), "4ss 1 0o|o"]


@pytest.fixture
def texts():
    return [*noise(11), None, *ODD]


def test_batches_equal_rows(texts):
    for steps in (COMPARISON - {"compatibilityForms"}, frozenset(["collapseRepeats"]), frozenset(["unifyLetters", "collapseWhitespace"])):
        made = B.each(texts, lambda c: B.apart(B.normalized(c, steps)), lambda t: T.normalize(t, steps))
        assert made == [T.normalize(t, steps) for t in texts]
    plain = [t or "" for t in texts]
    assert B.each(texts, lambda c: B.apart(B.squeezed(c)), T.squeeze) == [T.squeeze(t) for t in plain]
    assert B.each(texts, lambda c: B.apart(B.folded(c)), T.fold) == [T.fold(t) for t in plain]
    assert B.each(texts, B.words, T.words) == [T.words(t) for t in plain]


def test_readings_equal_rows(texts):
    lexicon = compile_lexicon(wordlist.parse(LIST_TEXT))
    for text, reads, bare in zip(texts, lexicon.finder.readings(texts), wordfind.readings(texts, lexicon.options)):
        normal, end, other = T.normalize(text), B.END_TEXT, chr(B.END - 1)
        want = dict.fromkeys([normal, T.squeeze(normal), T.fold(normal), T.squeeze(T.fold(normal))]) if normal else {}
        assert [t for _, t, _, _ in bare] == [*want] and [t for _, t, _, _ in reads] == [t.replace(end, other) for t in want]
        for _, t, words, _ in reads:
            assert words.names == T.words(t) and words.starts.tolist() == [a for _, a, _ in T.tokens(t)]
            assert lexicon.finder.held_in(words) == lexicon.finder.hot(words.names)


def test_chunks_are_looked_at_once(monkeypatch):
    lexicon, seen = compile_lexicon(wordlist.parse(LIST_TEXT)), []
    look = wordfind.Finder._chunk
    monkeypatch.setattr(wordfind.Finder, "_chunk", lambda self, piece: seen.append(piece) or look(self, piece))
    candidates = relational.Candidates(lexicon, relational.KINDS, True)
    rows = [candidates.of(reads) for reads in lexicon.finder.readings(["you f*ck, f*ck"] * 50)]
    assert rows == rows[:1] * 50 and rows[0]
    assert sorted(seen) == sorted(set(seen))


def explained(df) -> str:
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_relational_path_reads_texts_once(spark):
    df = spark.createDataFrame([(1, "you f*ck"), (2, None)], "id long, text string")
    plan = explained(relational.hits(df, "id", "text", compile_lexicon(wordlist.parse(LIST_TEXT))))
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan and "translate" not in plan


def test_streams_of_tables_in_many_files(spark, sf_dir, tmp_path):
    from textwarden.plans.queries import QUERIES

    for table in ("conversations", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    for name in ("message_stream", "stream_match_counts"):
        want = QUERIES[name](spark, sf_dir).collect()
        assert want and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(map(tuple, want))


def test_first_match_is_made_once(spark, sf_dir):
    from textwarden.plans.queries import QUERIES

    for name in ("first_matches", "first_match_entries"):
        assert explained(QUERIES[name](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_regions_of_parts_and_missing_values_equal_sql(spark, tmp_path):
    """Quantities between whole numbers, lines without a part, a quantity or a supplier, several lines of one number."""
    import duckdb

    from textwarden.plans.queries import ORACLES, QUERIES

    sql = """SELECT CAST(k % 40 AS BIGINT) AS l_orderkey, CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(k * 31 % 211 AS BIGINT) END AS l_partkey, CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(k * 7 % 19 AS BIGINT) END AS l_suppkey,
    CAST(1 + k * 5 % 4 AS INTEGER) AS l_linenumber, CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(k * 13 % 27 AS DOUBLE) / 2 END AS l_quantity FROM range(600) r(k)"""
    db = duckdb.connect()
    db.execute(f"CREATE TABLE lineitem AS {sql}")
    db.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    found, wanted = QUERIES["merge_regions"](spark, str(tmp_path)), db.sql(ORACLES["merge_regions"])
    order = [found.columns.index(c) for c in wanted.columns]
    assert sorted(map(str, (tuple(r[k] for k in order) for r in found.collect()))) == sorted(map(str, wanted.fetchall()))


def test_equal_texts_are_looked_at_once_a_batch(spark, tmp_path):
    """The lexicon goes to a worker with a file that each look at a text adds a line to."""
    from textwarden.operators import rowmatch
    from textwarden.plans.guard import Guard

    log = f"{tmp_path}/seen"

    def noted(lexicon, text, reads, look=rowmatch.matches):
        with open(log, "a") as f:
            f.write(f"{text}\n")
        return look(lexicon, text, reads)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rowmatch, "matches", noted)
        guard = Guard(wordlist.parse("click"))
        df = spark.createDataFrame([("click",), ("view",), (None,)] * 50, "text string").coalesce(1)
        rows = df.select("text", guard.matches("text").alias("m")).collect()
    assert [len(r.m) for r in rows] == [1, 0, 0] * 50
    with open(log) as f:
        assert sorted(f.read().split()) == ["None", "click", "view"]

"""Quality rules judged by host: rule failures are pooled by domain and shrunk by an empirical beta prior.

Each document is measured once. Its rule failures are summed by host (here: its source). A host's
failure rate of a rule is shrunk towards all hosts' mean by a beta prior whose two parameters come
from the moments of the hosts' rates, so a host of few documents needs more than bad luck to be judged.
Verdicts are joined back: a host whose shrunk rate of any rule is above HOST_LIMIT goes with all its
documents, and where a rule's shrunk rate is above HABIT, failing it is the host's habit and its
documents that fail this rule go. Elsewhere a single failure is taken as an exception.

Defined results: a null text has no words and fails the base rules; a document without a host is
judged by the base rules alone; repeated rows count as often as they occur; an empty table gives an
empty table. Other columns pass through ``judge`` by name, but for the names of the measures, which
keep cannot hold; ``measure`` reads only the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import materialize, slices, tidied

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A host goes if its shrunk rate of failures of one rule is above this.
HOST_LIMIT = 0.5
#: Above this shrunk rate a document goes for failing the rule.
HABIT = 0.05
#: Hosts with a verdict against them are counted, and broadcast up to so many; beyond that the join shuffles.
BROADCAST_HOSTS = 100_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of so many words that occur twice or more in the text."""
    grams = list(zip(*[words[k:] for k in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    count = Counter(grams)
    covered = end = 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if not line.isspace() and line]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def measure(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the five measures of each row, as long."""
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = source.drop("__text").selectExpr("*", *[f"0L AS {m}" for m in MEASURES]).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: list[tuple[int, ...]] = []
            for a, b in slices(batch.columns[-1]):
                found += map(measures, batch.columns[-1].slice(a, b - a).to_pylist())
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *MEASURES])

    return source.mapInArrow(tidied(batches), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_rules() -> dict[str, Column]:
    """The rules whose failures are pooled by host, on whole numbers, so that any engine agrees."""
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "same_lines": F.col("n_dup_lines") > 2,
    }


def host_verdicts(measured: DataFrame, host: str, limit: float = HOST_LIMIT, habit: float = HABIT) -> DataFrame:
    """host, n_docs, a shrunk rate for each rule (rate_...), host_kept, and habit_... for each rule.

    The prior of a rule: with m the mean of the hosts' rates and v their variance less what chance alone
    gives hosts of their sizes, m * (1 - m) * mean(1 / n_docs), the beta parameters are m * s and
    (1 - m) * s for s = m * (1 - m) / v - 1, held to 1..1,000,000. Where v is not above zero, the prior
    is as strong as it gets.
    """
    rules = host_rules()
    tallies = measured.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c.cast("long")).alias(f"bad_{r}") for r, c in rules.items()])
    tallies = materialize(tallies, "host-tallies")
    rates = [F.col(f"bad_{r}") / F.col("n_docs") for r in rules]
    moments = tallies.agg(F.avg(1 / F.col("n_docs")).alias("__chance"), *[f(x).alias(f"{n}_{r}") for r, x in zip(rules, rates) for n, f in (("m", F.avg), ("v", F.var_pop))])
    both = {r: F.col(f"m_{r}") * (1 - F.col(f"m_{r}")) for r in rules}
    between = {r: F.col(f"v_{r}") - both[r] * F.col("__chance") for r in rules}
    strength = {r: F.when(between[r] > 0, F.least(F.greatest(both[r] / between[r] - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6)) for r in rules}
    prior = moments.select(F.lit(1).alias("__one"), *[(F.col(f"m_{r}") * strength[r]).alias(f"a_{r}") for r in rules], *[strength[r].alias(f"s_{r}") for r in rules])
    shrunk = tallies.withColumn("__one", F.lit(1)).join(F.broadcast(prior), "__one")  # a single row
    shrunk = shrunk.select(host, "n_docs", *[((F.col(f"bad_{r}") + F.col(f"a_{r}")) / (F.col("n_docs") + F.col(f"s_{r}"))).alias(f"rate_{r}") for r in rules])
    return shrunk.select("*", (F.greatest(*[F.col(f"rate_{r}") for r in rules]) <= limit).alias("host_kept"), *[(F.col(f"rate_{r}") > habit).alias(f"habit_{r}") for r in rules])


def against(measured: DataFrame, host: str, limit: float, habit: float) -> DataFrame:
    """__host, __whole and __habit_... of hosts with a verdict against them: a written table, marked for broadcast if small."""
    verdicts = host_verdicts(measured, host, limit, habit)
    named = verdicts.select(F.col(host).alias("__host"), (~F.col("host_kept")).alias("__whole"), *[F.col(f"habit_{r}").alias(f"__habit_{r}") for r in host_rules()])
    some = materialize(named.filter(reduce(Column.__or__, [F.col(c) for c in named.columns[1:]])), "host-verdicts")
    return F.broadcast(some) if some.count() <= BROADCAST_HOSTS else some


def condemned() -> Column:
    """Whether a measured row, joined with its host's verdict if there is one, goes for it."""
    habits = [F.col(f"__habit_{r}") & c for r, c in host_rules().items()]
    return F.coalesce(reduce(Column.__or__, [F.col("__whole"), *habits]), F.lit(False))


def judge(df: DataFrame, host: str = "source", text: str = "text", keep: Sequence[str] = ("doc_id",), limit: float = HOST_LIMIT, habit: float = HABIT) -> DataFrame:
    """The columns of keep, the measures, base_failed, and kept: the verdict of rules and host.

    Verdicts are joined back to the measured rows, which are narrow. A large host's rows need not
    meet in one task: the verdicts are broadcast up to BROADCAST_HOSTS, and beyond that only their
    small side is replicated where the planner splits the rows.
    """
    columns = list(dict.fromkeys([*keep, host]))
    measured = materialize(measure(df, text, columns), "quality-rules")
    joined = measured.join(against(measured, host, limit, habit), F.col(host) == F.col("__host"), "left")
    failed = base_failed()
    return joined.select(*keep, *MEASURES, failed.alias("base_failed"), (~failed & ~condemned()).alias("kept"))


def measured(text: Column) -> Column:
    """The measures as a column: texts alone go to Python, the rest of a row stays where it is."""

    @F.arrow_udf("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    def run(texts: pa.Array) -> pa.Array:
        found: list[tuple[int, ...]] = []
        for a, b in slices(texts):
            found += map(measures, texts.slice(a, b - a).to_pylist())
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(MEASURES), names=MEASURES)

    return run(text.cast("string"))


def filter_documents(df: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT, habit: float = HABIT) -> DataFrame:
    """The rows of df, all columns unchanged, that ``judge`` would keep.

    Measures twice rather than moving whole texts through a shuffle or a second table.
    """
    verdicts = against(measure(df, text, [host]), host, limit, habit)
    packed = df.select(F.struct("*").alias("__row"), measured(F.col(text)).alias("__m"), F.col(host).alias("__host_of"))
    kept = packed.select("__row", "__host_of", "__m.*").filter(~base_failed()).join(verdicts, F.col("__host_of") == F.col("__host"), "left").filter(~condemned())
    return kept.select("__row.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
many AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM many) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
f AS (SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, 10 * n_symbols > n_words AS r3, n_dup_lines > 2 AS r4 FROM m),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS rule,
  unnest([count(*) FILTER (r1), count(*) FILTER (r2), count(*) FILTER (r3), count(*) FILTER (r4)]) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT rule, avg(bad / n) AS m, var_pop(bad / n) - avg(bad / n) * (1 - avg(bad / n)) * avg(1 / n) AS v FROM h GROUP BY rule),
s AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM p),
k AS (SELECT source, max((bad + m * s) / (n + s)) > 0.5 AS whole, list((bad + m * s) / (n + s) > 0.05 ORDER BY rule) AS habit FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
  NOT (r1 OR r2) AND NOT coalesce(whole OR (habit[1] AND r1) OR (habit[2] AND r2) OR (habit[3] AND r3) OR (habit[4] AND r4), false) AS kept
FROM f LEFT JOIN k USING (source)
"""

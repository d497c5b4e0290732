"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order, null last, get weights from a repeating list. They share a multiple of
all words; a source's target stops at ``most`` times its size, and the excess is shared again by
weight until none is above. Whole copies of a source, target / size of them, are certain. The rest is
drawn without replacement, with inclusion probabilities in proportion to the square root of a document's
words, so that a longer document is likelier, but its words are not as much likelier. They are scaled to
the words that are left; documents whose probability would pass 1 are certain, and the others are scaled
again. Of the others, ranks are random odds over inclusion odds, u / (1 - u) / (p / (1 - p)), and the
first are taken until the words are spent. What the first document too long for the rest leaves goes, in a
second pass, to the next that fit it, and then to one document whose size comes nearest, if that helps:
this last one is picked by size, outside the design, one document a source at most.

The random numbers are MD5 values of seed, id and text, so reruns agree. A source's ranks are never
sorted as a whole: sums by rank bins find the bin where its words are spent, and only that bin's
rows are put in order. The outcome is one row a source, the places where its draws end, and each
document decides by itself whether it comes before those.

Defined results: a null text has size 0 and is taken with 0 words; a null source is a source, the
last one; rows that repeat id and text are drawn together or not at all;
a source without words has target 0; an empty table gives an empty table. Other columns are not
read by ``mix`` and pass through ``resample`` unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import WORD_PATTERN, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BINS = 65_536
SEED = "mix"
#: Draws one after the other, each of documents that fit what the one before left.
PASSES = 2


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size).

    Sharing the excess again until none is above ends at one level for all: the target is the lesser
    of most * size and level * weight. Ordered by most * size / weight, the sources that stop come
    first, so running sums find the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = sizes.select("source", "source_size", weight.cast("long").alias("weight"))
    by_stop = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    below = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighted.select(
        "*",
        ((F.sum("source_size").over(every) * share - F.coalesce(F.sum("source_size").over(below), F.lit(0)) * most) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0)))).alias("level"),
    )
    # the first source whose own stop is not below the level of those still open fixes it
    fixed = levels.select("*", F.min(F.when(F.col("source_size") * most >= F.col("level") * F.col("weight"), F.struct((F.col("source_size") * most / F.col("weight")).alias("stop"), F.col("level").alias("level")))).over(every).alias("fix"))
    target = F.least((F.col("source_size") * most).cast("double"), F.coalesce(F.col("fix.level") * F.col("weight"), F.col("source_size") * F.lit(float(most))))
    return fixed.select("source", "source_size", target.alias("target"))


def uniform(seed: str, *columns: str) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the columns."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def sized(df: DataFrame, seed: str, keep: Sequence[str]) -> DataFrame:
    """The columns of keep, source, doc_id, size in words, and the document's random number u."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_PATTERN))
    return df.select(*keep, "source", F.col("doc_id").cast("long").alias("doc_id"), words.cast("long").alias("size"), uniform(seed, "doc_id", "text").alias("u"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def pull() -> Column:
    """What a document's inclusion probability is in proportion to, as a whole number."""
    return F.floor(F.sqrt(F.greatest("size", F.lit(1)).cast("double")) * 100)


def ranked(base: DataFrame, plan: DataFrame) -> DataFrame:
    """base with its source's row of the plan (goal_source and all), certain, rank and bin of the rank.

    Documents that are certain, and those of sources with nothing to draw, have no rank.
    """
    p = F.col("scale") * pull()
    joined = base.join(plan, same("source", "goal_source")).withColumn("p", p).withColumn("certain", F.coalesce(F.col("p") >= 1, F.lit(False)))
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    return joined.withColumn("rank", odds).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int")).withColumn("place", F.struct("rank", "doc_id", "size"))


def drawn(passes: int = PASSES) -> Column:
    """Whether a ranked row is among those that the words of a pass pay for."""
    found = F.lit(False)
    for k in range(passes):
        inside = (F.col("bin") == F.col(f"last_bin{k}")) & F.coalesce(F.col("place") <= F.col(f"last_place{k}"), F.lit(False))
        before = F.col(f"last_bin{k}").isNull() | (F.col("bin") < F.col(f"last_bin{k}")) | inside
        found = found | (F.coalesce(before, F.lit(False)) & (F.col("size") <= F.col(f"rest{k}")))
    return found & F.col("rank").isNotNull()


def scaled(base: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with scale, the factor from pull to probability, and rest0, the words left to draw after certain documents.

    Sizes in descending order, one row a size: while the factor for a size and all below it gives 1 or
    more, documents of this size are certain.
    """
    sizes = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).join(goals.filter("rest > 0"), same("source", "goal_source"))
    order = Window.partitionBy("source").orderBy(F.desc("size"))
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    words, weight = F.col("size") * F.col("n"), pull() * F.col("size") * F.col("n")
    left = F.col("rest") - F.coalesce(F.sum(words).over(above), F.lit(0))
    open_ = F.sum(weight).over(Window.partitionBy("source")) - F.coalesce(F.sum(weight).over(above), F.lit(0))
    rows = sizes.select("source", "size", left.alias("left"), F.when(open_ > 0, left / open_).alias("factor"))
    first = rows.filter(F.col("factor") * pull() < 1).groupBy("source").agg(F.max_by(F.struct("factor", "left"), "size").alias("f"))
    first = first.select(F.col("source").alias("scale_source"), F.col("f.factor").alias("scale"), F.col("f.left").alias("rest0"))
    return goals.join(first, same("goal_source", "scale_source"), "left").drop("scale_source", "rest")


def spent(rows: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """The plan with where pass k ends (last_bin, last_place) and the words that the next one has (rest)."""
    rest = f"rest{k}"
    by_bin = rows.groupBy("source", "bin", rest).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows a source at most
    running = by_bin.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = running.filter(F.col("before") + F.col("words") > F.col(rest)).groupBy("source").agg(F.min(F.struct("bin", "before")).alias("at"))
    ends = materialize(ends.select(F.col("source").alias("end_source"), F.col("at.bin").alias(f"last_bin{k}"), F.col("at.before").alias("before")), "mix-bins")
    inner = rows.join(ends, same("source", "end_source") & (F.col("bin") == F.col(f"last_bin{k}")))
    paid = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size"))  # alike rows together
    cut = inner.select("source", "place", "size", paid.alias("paid"), rest).filter(F.col("paid") <= F.col(rest)).groupBy("source").agg(F.max("place").alias(f"last_place{k}"), F.sum("size").alias("in_bin"))
    plan = plan.join(ends, same("goal_source", "end_source"), "left").join(cut, same("goal_source", "source"), "left")
    gap = F.when(F.col(f"last_bin{k}").isNotNull(), F.col(rest) - F.col("before") - F.coalesce("in_bin", F.lit(0))).otherwise(F.lit(0.0))
    return materialize(plan.withColumn(f"rest{k + 1}", gap).drop("end_source", "before", "source", "in_bin"), "mix-cuts")


def plan_sources(base: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: its size and target, certain copies, the scale of its odds, and where its draws end.

    base has source, doc_id, size and u and should be a written table, as it is read several times.
    """
    goals = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(wanted).cast("long")
    goals = materialize(goals.select(F.col("source").alias("goal_source"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest")), "mix-targets")
    plan = materialize(scaled(base, goals), "mix-scales")
    for k in range(PASSES):
        plan = spent(ranked(base, plan).filter(F.col("rank").isNotNull() & ~drawn(k) & (F.col("size") <= F.col(f"rest{k}"))), plan, k)
    gap = F.col(f"rest{PASSES}")
    off = F.abs(F.col("size") - gap)
    fits = ranked(base, plan).filter(F.col("rank").isNotNull() & ~drawn() & (off < gap))
    fill = fits.groupBy("source").agg(F.min(F.struct(off.alias("off"), "place")).alias("best")).select("source", F.col("best.place").alias("fill_place"))
    return materialize(plan.join(fill, same("goal_source", "source"), "left").drop("source"), "mix-plan")


def copied(base: DataFrame, plan: DataFrame) -> DataFrame:
    """base with its source's plan and the number of copies the mix takes of each row."""
    once = F.col("certain") | drawn() | F.coalesce(F.col("place") == F.col("fill_place"), F.lit(False))
    return ranked(base, plan).withColumn("copies", F.col("whole") + F.when(once, 1).otherwise(0))


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every document."""
    base = materialize(sized(documents, seed, []), "mix-sizes")
    rows = copied(base, plan_sources(base, weights, share, most))
    return rows.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resample(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of documents as often as the mix takes them, all columns unchanged.

    Texts meet only the plan, one row a source, so they are not dealt anew.
    """
    base = materialize(sized(documents, seed, []), "mix-sizes")
    plan = plan_sources(base, weights, share, most)
    packed = documents.select(F.struct("*").alias("__row"), "source", "doc_id", "text")
    rows = copied(sized(packed, seed, ["__row"]), plan)
    return rows.select("__row", F.explode(F.expr("array_repeat(0, cast(copies AS int))"))).select("__row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST('0x' || substr(md5(concat_ws(chr(31), 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, source_size * 2 / weight AS stop, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER b, 0) * 2)
  / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
  WINDOW b AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, stop) AS level FROM l WHERE source_size * 2 >= level * weight),
t AS (SELECT source, source_size, coalesce(least(source_size * 2::DOUBLE, f.level * weight), source_size * 2::DOUBLE) AS target FROM l, f),
g AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM t),
e AS (SELECT *, target - whole * source_size AS rest FROM g),
z AS (SELECT d.source, size, count(*) AS n, CAST(floor(sqrt(greatest(size, 1)::DOUBLE) * 100) AS BIGINT) AS pull, any_value(rest) AS rest
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source WHERE rest > 0 GROUP BY d.source, size),
y AS (SELECT *, rest - coalesce(sum(size * n) OVER a, 0) AS remains, sum(pull * size * n) OVER (PARTITION BY source) - coalesce(sum(pull * size * n) OVER a, 0) AS open FROM z
  WINDOW a AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT source, arg_max(remains / open, size) AS scale, arg_max(remains, size) AS rest0 FROM y WHERE open > 0 AND remains / open * pull < 1 GROUP BY source),
r AS (SELECT d.*, source_size, target, whole, rest0, scale * floor(sqrt(greatest(size, 1)::DOUBLE) * 100) AS p
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
k AS (SELECT *, coalesce(p >= 1, false) AS certain, CASE WHEN p > 0 AND p < 1 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM r),
c0 AS (SELECT *, rank IS NOT NULL AND size <= rest0 AS may FROM k),
c1 AS (SELECT *, may AND sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size) <= rest0 AS first FROM c0),
q1 AS (SELECT source, CASE WHEN bool_and(first) THEN 0 ELSE any_value(rest0) - coalesce(sum(size) FILTER (first), 0) END AS rest1 FROM c1 WHERE may GROUP BY source),
c2 AS (SELECT c1.*, rest1, rank IS NOT NULL AND NOT first AND size <= rest1 AS again FROM c1 LEFT JOIN q1 ON c1.source IS NOT DISTINCT FROM q1.source),
c3 AS (SELECT *, coalesce(again AND sum(CASE WHEN again THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size) <= rest1, false) AS second FROM c2),
q2 AS (SELECT source, CASE WHEN bool_and(second) THEN 0 ELSE any_value(rest1) - coalesce(sum(size) FILTER (second), 0) END AS gap FROM c3 WHERE again GROUP BY source),
b AS (SELECT c3.source, min(struct_pack(off := abs(size - gap), rank := rank, doc_id := doc_id, size := size)) AS best
  FROM c3 JOIN q2 ON c3.source IS NOT DISTINCT FROM q2.source WHERE rank IS NOT NULL AND NOT first AND NOT second AND abs(size - gap) < gap GROUP BY c3.source)
SELECT doc_id, size, source_size, target,
  (whole + CASE WHEN certain OR first OR second OR coalesce(rank = best.rank AND doc_id IS NOT DISTINCT FROM best.doc_id AND size = best.size, false) THEN 1 ELSE 0 END) * size AS taken
FROM c3 LEFT JOIN b ON c3.source IS NOT DISTINCT FROM b.source
"""

"""URL filters: host and path rules, and character language models for the URLs no rule fits.

Rules are a host and a path prefix written together; the longest rule that fits decides. The distinct
URLs that rules allow and block train two variable-order Markov models of characters: contexts of up to
ORDER - 1 characters, each filled in from the next shorter one by the number of distinct followers of a
context (Witten-Bell), the shortest by all characters. A URL without a rule is judged by the difference
of its log-likelihoods under the two, divided by its length. URLs are modelled whole and as they are:
scheme, host, path, query and fragment, every character its own.

The threshold is calibrated on training URLs that the models have not seen, some 3 of 16 by hash: the
one with the least sum of error shares there, in hundredths of nats a character, between -10 and 10. If
these lack a verdict that the other training URLs have, the threshold is 0.

All of it is DataFrame and SQL functions. Counts cover all URLs with a rule and grow with them; grams
are counted before they meet, and the planner picks how the weights are joined. Weights are whole
millionths, so sums do not depend on the order of rows.

Defined results: a null URL or one without "://" has an empty host and path and no rule, and is
judged as it is written, null as the empty string; if only one set has URLs its verdict goes to all, and
if none has, all are allowed; URLs of any length are read whole; repeated rows get repeated results; an
empty table gives an empty table; columns other than the id and the URL are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import materialize

#: (verdict, rule)
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of a gram: a context and what follows it.
ORDER = 5
#: Stand before the first character and after the last.
START, END = "\x02", "\x03"
#: URLs that one task counts grams of, about.
URLS_A_TASK = 20_000


def weights_sql(grams: str) -> str:
    """From grams (gram, ka, kb: times seen in allowed and blocked URLs) the weight of each, in millionths."""
    parts = []
    for n in range(1, ORDER + 1):
        parts.append(f"l{n} AS (SELECT substr(gram, {ORDER + 1 - n}, {n}) AS s, sum(ka) AS ka, sum(kb) AS kb FROM {grams} GROUP BY substr(gram, {ORDER + 1 - n}, {n}))")
        if n == 1:
            parts.append("every AS (SELECT sum(ka) AS na, sum(kb) AS nb, count(*) AS v FROM l1)")
            parts.append("p1 AS (SELECT s, (ka + 1.0D) / (na + v) AS pa, (kb + 1.0D) / (nb + v) AS pb FROM l1 CROSS JOIN every)")
            continue
        parts.append(f"c{n} AS (SELECT substr(s, 1, {n - 1}) AS c, sum(ka) AS na, sum(kb) AS nb, sum(CASE WHEN ka > 0 THEN 1 ELSE 0 END) AS ta, sum(CASE WHEN kb > 0 THEN 1 ELSE 0 END) AS tb FROM l{n} GROUP BY substr(s, 1, {n - 1}))")
        parts.append(f"""p{n} AS (SELECT l{n}.s AS s, CASE WHEN na > 0 THEN (ka + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (kb + tb * pb) / (nb + tb) ELSE pb END AS pb
  FROM l{n} JOIN c{n} ON substr(l{n}.s, 1, {n - 1}) = c{n}.c JOIN p{n - 1} ON substr(l{n}.s, 2, {n - 1}) = p{n - 1}.s)""")
    return f"WITH {', '.join(parts)} SELECT s AS gram, CAST(round(1000000 * (ln(pa) - ln(pb))) AS BIGINT) AS weight FROM p{ORDER}"


#: From s (rule_verdict, bucket) of the held-out URLs the least bucket to allow; no row without both sets.
THRESHOLD_SQL = """
WITH b AS (SELECT bucket, sum(CASE WHEN rule_verdict = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN rule_verdict = 'block' THEN 1 ELSE 0 END) AS b FROM {s} GROUP BY bucket),
r AS (SELECT bucket, coalesce(sum(a) OVER w, 0) AS lost, coalesce(sum(b) OVER w, 0) AS stopped FROM b
  WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b FROM b),
e AS (SELECT bucket, CAST(round(1000000000 * (lost / (SELECT a FROM t) + 1 - stopped / (SELECT b FROM t))) AS BIGINT) AS error FROM r
  WHERE (SELECT a FROM t) > 0 AND (SELECT b FROM t) > 0)
SELECT bucket AS least FROM e ORDER BY error, bucket LIMIT 1
"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def parsed(urls: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns of keep, host and path."""
    host = lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))
    return urls.select(*keep, host.alias("host"), path.alias("path"))


def rule_fits(rule: str) -> Column:
    host, path = rule[: rule.index("/")], rule[rule.index("/") :]
    return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds rule and rule_verdict, null where no rule fits; of rules as long, the first given."""
    longest = sorted(rules, key=lambda r: -len(r[1]))
    nothing = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(rule_fits(r), F.lit(r)) for _, r in longest], nothing)
    verdict = F.coalesce(*[F.when(rule_fits(r), F.lit(v)) for v, r in longest], nothing)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def grams(url: str = "url") -> Column:
    """The overlapping runs of ORDER characters of a URL, marks of start and end included."""
    text = F.concat(F.lit(START * (ORDER - 1)), F.col(url), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) - (ORDER - 1)), lambda i: F.substring(text, i, F.lit(ORDER)))


def held_out(url: str = "url") -> Column:
    return F.substring(F.md5(url), 1, 1).isin("0", "1", "2")


def verdicts(distinct: DataFrame) -> DataFrame:
    """url, lm_verdict of distinct URLs, none null; distinct has rule_verdict too.

    It should be a written table, as counting and scoring both read it.
    """
    spark = distinct.sparkSession
    tasks = max(1, math.ceil(distinct.count() / URLS_A_TASK))
    dealt = distinct.repartition(tasks, "url")
    each = dealt.select("url", "rule_verdict", held_out().alias("held"), F.explode(grams()).alias("gram"))
    trains = lambda verdict: F.count_if((F.col("rule_verdict") == verdict) & ~F.col("held"))
    seen = materialize(each.groupBy("gram").agg(trains("allow").alias("ka"), trains("block").alias("kb")), "url-grams")
    seen.createOrReplaceTempView(view := f"url_grams_{uuid.uuid4().hex}")
    weights = materialize(spark.sql(weights_sql(view)), "url-weights")
    spark.catalog.dropTempView(view)
    counted = each.groupBy("url", "gram").agg(F.count(F.lit(1)).alias("n"))
    summed = counted.join(weights, "gram").groupBy("url").agg(F.sum(F.col("weight") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    bucket = F.floor(F.col("s") / (F.col("n") * F.lit(10000.0)))
    scored = summed.select("url", F.greatest(F.least(bucket, F.lit(1000)), F.lit(-1000)).cast("long").alias("bucket"))
    scored = materialize(distinct.join(scored, "url").select("url", "rule_verdict", held_out().alias("held"), "bucket"), "url-scores")
    trained = scored.filter("rule_verdict IS NOT NULL")
    least = spark.sql(THRESHOLD_SQL, s=trained.filter("held")).select("least")
    found = trained.agg(F.min("rule_verdict").alias("first"), F.max("rule_verdict").alias("last"))
    one = F.when(F.col("first") == F.col("last"), F.col("first")).when(F.col("first").isNull(), F.lit("allow"))
    fixed = found.join(least, how="left", on=F.lit(True)).select(F.lit(1).alias("one"), one.alias("only"), F.coalesce("least", F.lit(0)).alias("least"))  # one row
    judged = scored.withColumn("one", F.lit(1)).join(F.broadcast(fixed), "one")
    verdict = F.coalesce("only", F.when(F.col("bucket") >= F.col("least"), F.lit("allow")).otherwise(F.lit("block")))
    return judged.select("url", verdict.alias("lm_verdict"))


def judge(urls: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The columns of keep, host, path, rule and verdict of every row."""
    named = urls.select(*keep, F.coalesce(F.col(url).cast("string"), F.lit("")).alias("__url"))
    rows = with_rules(parsed(named, "__url", [*keep, "__url"]), rules)
    distinct = materialize(with_rules(parsed(named.select("__url").distinct(), "__url", ["__url"]), rules).select(F.col("__url").alias("url"), "rule_verdict"), "urls")
    judged = rows.join(verdicts(distinct).withColumnRenamed("url", "__url"), "__url")
    return judged.select(*keep, "host", "path", "rule", F.coalesce("rule_verdict", "lm_verdict").alias("verdict"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    fits = lambda r: f"((host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest)
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS rule_verdict FROM p),
u AS (SELECT DISTINCT url, rule_verdict, substr(md5(url), 1, 1) IN ('0', '1', '2') AS held FROM r),
x AS (SELECT *, repeat(chr(2), {ORDER - 1}) || url || chr(3) AS t FROM u),
each AS (SELECT url, rule_verdict, held, substr(t, i, {ORDER}) AS gram FROM (SELECT *, unnest(range(1, length(t) - {ORDER - 2})) AS i FROM x)),
seen AS (SELECT gram, count(*) FILTER (rule_verdict = 'allow' AND NOT held) AS ka, count(*) FILTER (rule_verdict = 'block' AND NOT held) AS kb FROM each GROUP BY gram),
weights AS ({weights_sql("seen").replace("1.0D", "1.0::DOUBLE")}),
scored AS (SELECT url, any_value(rule_verdict) AS rule_verdict, any_value(held) AS held,
  CAST(greatest(least(floor(sum(weight) / (count(*) * 10000.0::DOUBLE)), 1000), -1000) AS BIGINT) AS bucket FROM each JOIN weights USING (gram) GROUP BY url),
trained AS (SELECT * FROM scored WHERE rule_verdict IS NOT NULL),
tests AS (SELECT * FROM trained WHERE held),
least AS ({THRESHOLD_SQL.format(s="tests")})
SELECT page_id, r.host, r.path, rule, coalesce(r.rule_verdict, CASE WHEN (SELECT count(DISTINCT rule_verdict) FROM trained) < 2 THEN coalesce((SELECT min(rule_verdict) FROM trained), 'allow')
  WHEN bucket >= coalesce((SELECT least FROM least), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN scored USING (url)
"""

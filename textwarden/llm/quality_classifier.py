"""Quality classifier: a sparse rule ensemble over text statistics.

Small trees are grown on residuals of labelled rows' statistics; every path from a root to a node is
a conjunctive rule; a lasso logistic fit gives most rules no weight; the rest become one Spark
column expression. Statistics are computed in Arrow batches, rules and scores in the JVM.

The trees and weights are fitted on the driver to at most ``max_rows`` labelled rows, chosen by the
hash of their id. Scores cover all rows. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have zero statistics and are scored like any text; rows
without a usable label teach nothing; with one class alone, or no labelled row, every score is that
class's share (0.5 for no row); a repeated doc_id teaches once; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import slices, tidied
from textwarden.llm.quality_rules import repeated_words

STATISTICS = ("words", "word_length", "symbols", "capitals", "digits", "bangs", "bars", "stops", "distinct", "repeats", "same_lines", "line_words", "marks", "high_bytes")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#*$%&<>@^~=+_{}[]\\/"
HIGH = bytes(range(128, 256))

MAX_ROWS = 12_000
TREES = 30
DEPTH = 3
BINS = 24
LASSO = (0.03, 0.01, 0.003, 0.001)


def statistics(text: str | None) -> tuple[float, ...]:
    """The STATISTICS of one text; shares are of words, letters counted in bytes."""
    if not text:
        return (0.0,) * len(STATISTICS)
    data = text.encode()
    words = data.split()
    n = max(1, len(words))
    held = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
    size = max(1, len(data) - held)
    count = lambda which: len(data) - len(data.translate(None, which))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    many = max(1, len(lines))
    return (
        float(len(words)),
        size / n,
        count(b"#*$%&|<>") / n,
        count(CAPITALS) / size,
        count(b"0123456789") / size,
        data.count(b"!") / n,
        data.count(b"|") / n,
        (data.count(b". ") + data.count(b".\n")) / n,
        len(set(words)) / n,
        repeated_words(words) / n,
        (len(lines) - len(set(lines))) / many,
        len(words) / many,
        count(MARKS) / size,
        count(HIGH) / size,
    )


def measure(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of keep and stat_<name> (double) for each row."""
    names = [f"stat_{s}" for s in STATISTICS]
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = source.drop("__text").selectExpr("*", *[f"0D AS {n}" for n in names]).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: list[tuple[float, ...]] = []
            for a, b in slices(batch.columns[-1]):
                found += map(statistics, batch.columns[-1].slice(a, b - a).to_pylist())
            columns = [pa.array(c, pa.float64()) for c in zip(*found)] or [pa.array([], pa.float64())] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *names])

    return source.mapInArrow(tidied(batches), schema)


#: A condition is (statistic, above, threshold); a rule is the conjunction of its conditions.
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; the score is the logistic of the bias and the weights of the rules that hold."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as a Spark expression over the stat_ columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, above, threshold in rule:
                stat = F.col(f"stat_{STATISTICS[k]}")
                holds = holds & ((stat > threshold) if above else (stat <= threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * satisfied(rule, x)
        return 1 / (1 + np.exp(-total))


def satisfied(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, threshold in rule:
        out &= (x[:, k] > threshold) if above else (x[:, k] <= threshold)
    return out


def grow(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], features: np.ndarray, depth: int, path: tuple[Condition, ...], rules: list, least: int) -> np.ndarray:
    """A regression tree on target; notes the path of every node below the root, returns its fit."""
    fit = np.full(len(x), target.mean() if len(x) else 0.0)
    if not depth or len(x) < 2 * least:
        return fit
    best = (1e-9, -1, 0.0)
    for k in features:
        if not len(cuts[k]):
            continue
        bucket = np.searchsorted(cuts[k], x[:, k], side="left")
        n = np.cumsum(np.bincount(bucket, minlength=len(cuts[k]) + 1))[:-1]
        s = np.cumsum(np.bincount(bucket, target, minlength=len(cuts[k]) + 1))[:-1]
        m, total = len(x), target.sum()
        gain = np.where((n >= least) & (m - n >= least), s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m - n, 1) - total**2 / m, -1)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), int(k), float(cuts[k][at]))
    if best[1] < 0:
        return fit
    above = x[:, best[1]] > best[2]
    for side in (False, True):
        deeper = (*path, (best[1], side, best[2]))
        rules.append(deeper)
        part = above == side
        fit[part] = grow(x[part], target[part], cuts, features, depth - 1, deeper, rules, least)
    return fit


def simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound for each statistic and side, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for k, above, t in rule:
        old = bounds.get((k, above))
        bounds[k, above] = t if old is None else (max(old, t) if above else min(old, t))
    return tuple((k, above, t) for (k, above), t in sorted(bounds.items()))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the mean logistic loss; the bias is not penalised."""
    scale = np.maximum(z.std(axis=0), 1e-6)
    a = np.hstack([z / scale, np.ones((len(z), 1))])
    step = 4 / max(1e-9, np.linalg.norm(a, 2) ** 2 / len(a))
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        new = v - step * (a.T @ (p - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[-1]), w[:-1] / scale


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 11) -> RuleEnsemble:
    """Rules and weights from statistics x and labels y (0 or 1)."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return RuleEnsemble(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 2)[1:-1], method="lower")) for k in range(x.shape[1])]
    extra = [np.unique(np.concatenate([c, (np.unique(x[y == 0, k])[:: max(1, len(np.unique(x[y == 0, k])) // BINS)])])) for k, c in enumerate(cuts)]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(extra)]
    paths: list[tuple[Condition, ...]] = []
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    least = max(2, len(y) // 500)
    for _ in range(trees):
        some = rng.random(len(y)) < 0.6
        residual = y - 1 / (1 + np.exp(-total))
        features = rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False)
        tree: list[tuple[Condition, ...]] = []
        grow(x[some], residual[some], cuts, features, DEPTH, (), tree, least)
        paths += tree
        leaves = [r for r in tree if not any(o != r and o[: len(r)] == r for o in tree)]
        for leaf in leaves:
            inside = satisfied(leaf, x)
            if inside.any():
                total[inside] += np.clip(residual[inside].mean() * 4, -1, 1)
    rules = list(dict.fromkeys(map(simplified, paths)))
    z = np.array([satisfied(r, x) for r in rules], float).T.reshape(len(y), -1)
    _, first = np.unique(z, axis=1, return_index=True)
    first = [i for i in sorted(first) if 0 < z[:, i].mean() < 1]
    rules, z = [rules[i] for i in first], z[:, first]
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))))
    check = np.arange(len(y)) % 4 == 0
    losses = []
    for penalty in LASSO:
        bias, w = lasso_logistic(z[~check], y[~check], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[check] @ w + bias))), 1e-6, 1 - 1e-6)
        losses.append(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())
    bias, w = lasso_logistic(z, y, LASSO[int(np.argmin(losses))])
    return RuleEnsemble(bias, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Fits the ensemble to labelled rows that are not held out, max_rows of them at most."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    usable = usable.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("double").alias("__y"))
    chosen = usable.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = documents.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("__id", "__y", F.col("text").alias("__body"))
    stats = measure(texts, "__body", ["__id", "__y"])
    names = [f"stat_{s}" for s in STATISTICS]
    rows = stats.groupBy("__id", "__y").agg(F.min(F.struct(*names)).alias("s")).orderBy("__id").select("__y", "s.*").toPandas()
    data = rows.to_numpy(float).reshape(-1, 1 + len(names))
    return fit(data[:, 1:], data[:, 0])


def score(df: DataFrame, model: RuleEnsemble, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of keep, score and predicted for each row."""
    value = model.column()
    scored = measure(df, text, keep).select(*keep, value.alias("score"))
    return scored.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def measured(text: Column) -> Column:
    """The statistics as a column: texts alone go to Python, the rest of a row stays where it is."""

    @F.arrow_udf("struct<" + ",".join(f"stat_{n}:double" for n in STATISTICS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        found: list[tuple[float, ...]] = []
        for a, b in slices(texts):
            found += map(statistics, texts.slice(a, b - a).to_pylist())
        names = [f"stat_{n}" for n in STATISTICS]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in zip(*found)] or [pa.array([], pa.float64())] * len(names), names=names)

    return run(text.cast("string"))


def filter_documents(df: DataFrame, model: RuleEnsemble, text: str = "text") -> DataFrame:
    """The rows of df, all columns unchanged, that the model predicts to be of quality 1."""
    packed = df.select(F.struct("*").alias("__row"), measured(F.col(text)).alias("__m")).select("__row", "__m.*")
    return packed.filter(model.column() >= 0.5).select("__row.*")

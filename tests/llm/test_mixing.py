import re
from collections import defaultdict

import pytest

from textwarden.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in above}
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1000, "b": 10, "c": 10, None: 500}, {"é": 5, "z": 70, "Z": 900, "aa": 0}, {f"s{i}": (i * 37) % 101 for i in range(20)}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


def test_mix_meets_targets(spark):
    texts = ["w " * (1 + (i * 7919) % 97) for i in range(600)]
    rows = [(i, texts[i], [None, "a", "b", "c", "d"][i % 5] if i > 300 else "a") for i in range(600)]
    rows += [(700, None, "a"), (701, "", "void"), (None, "x y", "b"), (5, texts[5], "a"), (5, texts[5], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS copies", "3 AS rank")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        source = next(s for i, t, s in rows if i == r.doc_id and len(re.findall(r"\S+", t or "")) == r.size)
        size[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 0.02 * size[s] + 5
    sampled = mixing.resample(df)
    assert sampled.columns == df.columns
    assert sampled.count() == sum(r.copies for r in got)


def test_longer_documents_are_likelier(spark):
    rows = [(i, "w " * (10 if i % 2 else 160), "a") for i in range(4000)] + [(9000 + i, "w " * 40, "b") for i in range(4000)] + [(20_000, "w " * 50_000, "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1), share=0.5).collect()
    taken = {r.doc_id: r.copies for r in got}
    target = next(r.target for r in got if r.source == "a")
    assert abs(sum(r.taken for r in got if r.source == "a") - target) <= 10
    # by the square root of 160 / 10: four times as likely; a plain shuffle would take both alike
    short, long = (sum(taken[i] for i in range(k, 4000, 2)) for k in (1, 0))
    assert 3 < long / short < 5
    assert taken[20_000] == 1  # its probability would pass 1, so it is certain


def test_one_very_long_document_leaves_no_gap(spark):
    rows = [(i, "w " * (50 + i), "a") for i in range(300)] + [(1000, "w " * 100_000, "a"), (1001, "w " * 7000, "b")] + [(2000 + i, "w " * 20, "b") for i in range(300)]
    for seed in ("mix", "other", "third"):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1), share=0.3, seed=seed).collect()
        for source in ("a", "b"):
            target, size = next((r.target, r.source_size) for r in got if r.source == source)
            assert abs(sum(r.taken for r in got if r.source == source) - target) <= 0.02 * size


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

import numpy as np
import pytest

from textwarden.llm import ann


def brute(rows, queries, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault((i, tuple(v)), np.array(v, np.float32).astype(float))
    out = {}
    for i, v in queries:
        if (i, tuple(v or ())) not in usable:
            continue
        best = {}
        for (j, w), x in usable.items():
            if j != i and len(w) == len(v):
                best[j] = max(best.get(j, -np.inf), float(np.array(v, np.float32).astype(float) @ x))
        out[i] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


@pytest.mark.parametrize("shard_rows", [100, 4096])
def test_recall_and_scores(spark, shard_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    data = (centres[rng.integers(0, 6, 600)] + rng.normal(size=(600, 16)) * 0.5) * rng.uniform(0.5, 2, (600, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS ids")
    found = ann.search(ann.index(df, shard_rows=shard_rows), df.filter("vec_id % 20 = 0")).collect()
    want = brute(rows, rows[::20], 20)
    hits = 0
    for q, best in want.items():
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        for _, i, s in got:
            assert abs(s - np.array(rows[q][1]) @ np.array(rows[i][1])) < 1e-9
        hits += len({i for _, i, _ in got} & {i for _, i in best})
    assert hits >= 0.95 * 20 * len(want)


def test_defined_cases(spark):
    same, far = [1.0, 0.0], [0.0, 1.0]
    rows = [(i, same) for i in range(60)] + [(100, far), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [None, 1.0]), (105, [1.0, 2.0, 3.0]), (106, [float("inf"), 0.0]), (None, same), (100, far), (0, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(ann.index(df), df.filter("vec_id % 20 = 0 OR vec_id = 105"))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = {q: b for q, b in brute(rows, [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] == 105)], 20).items() if b}
    assert got == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(ann.index(empty), empty).count() == 0
    assert ann.search(ann.index(empty), df).count() == 0

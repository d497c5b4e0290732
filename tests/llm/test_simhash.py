import random

import numpy as np
import pytest
import xxhash

from textwarden.llm import simhash
from textwarden.llm.components import components


def brute_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, distance=2):
    label = {f: f for f in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    distinct = sorted(set(prints))
    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if (x ^ y).bit_count() <= distance:
                label[root(x)] = root(y)
    least = {}
    for i, f in zip(ids, prints):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [least.get(root(f)) for f in prints]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "x y z", "É A\xa0b c\nd\x0be\x1cf", "tok " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_equals_spark_hash(spark):
    got = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert simhash.fingerprint("ONE two  three") == got % 2**64


def crowd(seed, n):
    rng = random.Random(seed)
    centre, out = rng.getrandbits(64), []
    for _ in range(n):
        x = centre if rng.random() < 0.8 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3, 6])):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("parts,pairs", [(2, 4096), (2, 4), (3, 4096), (3, 10)])
def test_links_connect_all_near_pairs(spark, parts, pairs):
    prints = crowd(parts, 500)
    rows = [(np.uint64(f).astype(np.int64).item(),) for f in set(prints)]
    found = simhash.links(spark.createDataFrame(rows, "fp long"), parts=parts, bucket_pairs=pairs)
    for r in found.collect():
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 2
    label = {r.node: r.component for r in components(found, "a", "b").collect()}
    got = [label.get(f, f) for (f,) in rows]
    want = brute_components([f for (f,) in rows], [f % 2**64 for (f,) in rows])
    assert got == want


def test_thresholds_keep_the_principle():
    sample = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    for m in (1, 2, 3, 4):
        parts = simhash.correlated_parts(sample, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert sum(simhash.thresholds(parts, sample, 10**6)) == 2 - m + 1


def test_near_duplicates_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (5, docs[7][1]), (None, docs[8][1]), (None, "only here and nowhere else"), (9, docs[9][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [brute_fingerprint(t) for _, t in docs]
    ids = [i for i, _ in docs]
    assert got == sorted(zip(ids, prints, brute_components(ids, prints)), key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0

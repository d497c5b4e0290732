import itertools
import random
import re

import corpus_pipeline
import pytest

from textwarden.llm import simhash, similar


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(texts):
    """The number of a component for each text, by all pairs."""
    sets = [brute_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                label = [label[i] if v == label[j] else v for v in label]
    return label


def least_ids(ids, texts):
    least = {}
    for i, g in zip(ids, brute_groups(texts)):
        least[g] = min(i, least.get(g, i))
    return sorted(least.values())


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"e{rng.getrandbits(40)}"
    return " ".join(out)


@pytest.mark.parametrize("seed,sample", [(98, 16384), (4, 16384), (7, 3)])
def test_groups_against_all_pairs(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    rng = random.Random(seed)
    line = "one line that very many of these texts have in common"
    texts = [None, "", " \n", "a", "A", "a b c d", "a B c  d", "x y z"]
    for n in (6, 30, 60, 200):
        base = [f"w{rng.getrandbits(40)}" for _ in range(n)]
        texts += [edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(25)]
    texts += [f"{line} " + " ".join(f"u{rng.getrandbits(40)}" for _ in range(rng.choice([2, 8, 30]))) for _ in range(40)]
    ids = rng.sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n")
    kept = similar.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == least_ids(ids, texts)


def test_stage_drops_texts_similar_by_five_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    rows = docs.collect()
    assert sorted(r.doc_id for r in stage(spark, docs, sf_dir).collect()) == least_ids([r.doc_id for r in rows], [r.text for r in rows])


def test_rows_are_told_apart_by_text(spark):
    words = lambda x: " ".join(f"{x}{k}" for k in range(50))
    rows = [(3, words("a")), (9, words("a")), (9, words("b")), (7, words("c")), (7, words("d")), (7, words("d")), (None, words("a")), (None, words("e")), (None, words("e"))]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept.collect()) == [(0, "e"), (3, "a"), (7, "c"), (7, "d"), (9, "b")]
    assert similar.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_operator_7_brings_candidates(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.getrandbits(40)}" for _ in range(1500)] for _ in range(3)]
    texts = [edited(rng, b, k) for b in base for k in (0, 1, 1, 2, 3)] + [" ".join(base[0]).upper(), " ".join(base[0]) + " \n", None, "", "x y"]
    prints = {simhash.fingerprint(t, 5) for t in texts}
    label = {p: p for p in prints}
    for x, y in itertools.combinations(prints, 2):
        if (x ^ y).bit_count() <= simhash.DISTANCE and label[x] != label[y]:
            label = {p: label[x] if v == label[y] else v for p, v in label.items()}
    assert len(set(label.values())) < len(prints) < len(set(texts)) - 1

    asked, verified = [], similar.verified
    monkeypatch.setattr(similar, "ENDS", 0)  # what is left in the first round are the operator's pairs
    monkeypatch.setattr(similar, "verified", lambda *x: asked.append({(r.a, r.b) for r in x[2].collect()}) or verified(*x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = {r.doc_id: r.id for r in df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS id").collect()}
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == least_ids(range(len(texts)), texts)
    met = {i: i for i in key.values()}
    for a, b in asked[0]:
        met = {i: met[a] if v == met[b] else v for i, v in met.items()}
    for x, y in itertools.combinations(range(len(texts)), 2):
        assert (met[key[x]] == met[key[y]]) == (label[simhash.fingerprint(texts[x], 5)] == label[simhash.fingerprint(texts[y], 5)])

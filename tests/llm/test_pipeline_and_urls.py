import re
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from test_quality import brute_kept
from test_similar import least_ids
from tokenizers import Tokenizer

from textwarden.llm import common, mixing, queries, quality_classifier, url_filter


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    tables = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ruled, good, unique, mixed, encoded = tables

    stays = brute_kept([(r.text, r.source) for r in start])
    assert sorted(r.doc_id for r in ruled) == sorted(r.doc_id for r, s in zip(start, stays) if s)

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    frame = spark.read.parquet(str(tmp_path / "0"))
    model = quality_classifier.train(frame, labels)
    assert {r.doc_id for r in good} == {r.doc_id for r in quality_classifier.score(frame, model).filter("predicted = 1").collect()}

    # the stage takes five words and a similarity of 0.8, not the bits of op7_simhash
    assert sorted(r.doc_id for r in unique) == least_ids([r.doc_id for r in good], [r.text for r in good])

    copies = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: c for i, c in copies.items() if c})

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(encoded) == len(mixed)
    text = {r.doc_id: r.text for r in mixed}
    for r in encoded:
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_hostile_documents_pass_every_stage(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c " * 5, "en", None, 1), (3, "w" * 100_000, "en", "s", 1), (4, " ".join(f"w{i}" for i in range(50)), "en", "s", 1)]
    rows += [(10 + i, " ".join(f"u{i}x{j}" for j in range(40)), "en", f"t{i % 3}", 5) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        folder = str(tmp_path / str(part.count()))
        part.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns == ["doc_id", "source", "n_tokens", "ids"]
        assert got.count() >= (15 if part is docs else 0)


@pytest.mark.parametrize("url,host,path,rule", [
    (None, "", "", None), ("", "", "", None), ("no scheme/x", "", "", None), ("http://A.Org/x?y#z", "a.org", "/x", "org/"), ("http://org", "org", "", None),
    ("https://m.Example.org/es/1#t", "m.example.org", "/es/1", "example.org/es/"), ("x://example.org/en/19", "example.org", "/en/19", "example.org/en/1"), ("x://example.org/en/29", "example.org", "/en/29", "org/"),
    ("x://notexample.org/es/", "notexample.org", "/es/", "org/"), ("a://b.com/de/?x", "b.com", "/de/", "com/de/"), ("a://b.com/fr", "b.com", "/fr", None), ("a://b.net/c://d.org/", "b.net", "/c://d.org/", None), ("://É.com/fr/\nq", "É.com", "/fr/\nq", "com/fr/"),
])
def test_url_rules(spark, url, host, path, rule):
    row = url_filter.with_rules(url_filter.parsed(spark.createDataFrame([(1, url)], "page_id long, url string"))).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)


def brute_verdicts(urls):
    """Witten-Bell models of characters by counting, and the threshold with the least error shares on held-out URLs."""
    import hashlib
    import math

    order = url_filter.ORDER
    texts = {u: "\x02" * (order - 1) + u + "\x03" for u in urls}
    held = {u: hashlib.md5(u.encode()).hexdigest()[0] in "012" for u in urls}
    windows = lambda t: [t[i : i + order] for i in range(len(t) - order + 1)]
    sides = {v: Counter(g for u, t in texts.items() if urls[u] == v and not held[u] for g in windows(t)) for v in ("allow", "block")}
    seen = {g for t in texts.values() for g in windows(t)}
    alphabet = {g[-1] for g in seen}
    within = {v: {} for v in sides}
    for v, count in sides.items():
        for g, n in count.items():
            for k in range(order):
                within[v].setdefault(g[order - 1 - k : order - 1], Counter())[g[-1]] += n

    def probability(v, g):
        first = within[v].get("", Counter())
        p = (first[g[-1]] + 1) / (sum(first.values()) + len(alphabet))
        for k in range(1, order):
            follow = within[v].get(g[order - 1 - k : order - 1])
            if follow:
                p = (follow[g[-1]] + len(follow) * p) / (sum(follow.values()) + len(follow))
        return p

    weight = {g: round(1e6 * (math.log(probability("allow", g)) - math.log(probability("block", g)))) for g in seen}
    bucket = {u: max(-1000, min(1000, math.floor(sum(map(weight.get, windows(t))) / (len(windows(t)) * 10000)))) for u, t in texts.items()}
    a = [bucket[u] for u in urls if urls[u] == "allow" and held[u]]
    b = [bucket[u] for u in urls if urls[u] == "block" and held[u]]
    least = min(sorted({*a, *b}), key=lambda g: (round(1e9 * (sum(x < g for x in a) / len(a) + sum(x >= g for x in b) / len(b))), g)) if a and b else 0
    return {u: v or ("allow" if bucket[u] >= least else "block") for u, v in urls.items()}


def test_url_model_against_brute_force(spark, sf_dir):
    extra = [(10**6, None, None), (10**6, "x", "y"), (None, "http://É\n.com/fr/", ""), (7, "https://a.com/" + "q" * 20_000 + "?é=1#Ж", "")]
    extra += [(8, f"https://news.b.net/{k}?id=9{k}&x=Я{k}", "") for k in range(40)] + [(9, f"https://t.com/de/{k}?buy=now", "") for k in range(40)]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    named = pages.selectExpr("coalesce(url, '') AS url")
    rules = {r.url: r.rule_verdict for r in url_filter.with_rules(url_filter.parsed(named, "url", ["url"])).collect()}
    want = brute_verdicts(rules)
    rows = url_filter.judge(pages.withColumn("host", pages.url), keep=("page_id", "url")).collect()
    assert len(rows) == pages.count()
    assert all(r.verdict == want[r.url or ""] for r in rows)
    assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}


def test_url_defined_cases(spark):
    urls = lambda *x: spark.createDataFrame(list(enumerate(x)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS verdict")
    verdicts = lambda *x: [r.verdict for r in url_filter.judge(urls(*x)).orderBy("page_id").collect()]
    assert verdicts("a://b.net/", None) == ["allow", "allow"]
    assert verdicts("a://b.com/de/", "a://b.net/") == ["block", "block"]
    assert url_filter.judge(urls("x").limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, wanted = queries.queries()[name](spark, sf_dir), db.sql(queries.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(str([rounded(r[n]) for n in names]) for r in found.collect()) == sorted(str([rounded(r[wanted.columns.index(n)]) for n in names]) for r in wanted.fetchall())


def test_stages_send_small_batches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select("doc_id", "text").coalesce(1).crossJoin(spark.range(24)).coalesce(1)
    assert texts.selectExpr("sum(octet_length(text))").first()[0] > 3 * common.BATCH_BYTES

    def measured(it):
        for batch in it:
            longest = max(len((t or "").encode()) for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes], "rows": [batch.num_rows], "longest": [longest]})

    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(common.BATCHES)
        stage(spark, docs, sf_dir)
        if name != "mixing":  # which sends nothing to Python
            got = texts.mapInArrow(measured, "n long, rows long, longest long").collect()
            assert sum(r.rows for r in got) == texts.count() and all(r.n <= 1.1 * common.BATCH_BYTES + 2 * r.longest for r in got)
    for own, then in (("1000", "1000"), ("900000000", str(common.BATCH_BYTES))):
        spark.conf.set(common.BATCHES, own)
        common.small_batches(spark)
        assert spark.conf.get(common.BATCHES) == then
    spark.conf.unset(common.BATCHES)

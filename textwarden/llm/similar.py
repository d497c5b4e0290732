"""Near-duplicates by exact Jaccard similarity of word shingles, found by SimHash and completed by prefix filtering.

Candidates come from operator 7: fingerprints of each text, correlated parts of them, thresholds by dynamic
programming, buckets and probes. Texts whose fingerprints it links are verified on their shingles. At its two
bits it meets only almost equal texts, and no distance that can be searched reaches all texts of
similarity 0.8, so prefixes of ordered shingles find every link that fingerprints leave out.

A text's shingles are the distinct runs of SHINGLE words, ASCII in lower case, as 64-bit values. Two
texts are linked where their shingles' Jaccard similarity is at least SHARE[0] / SHARE[1]. Under any
one order of all shingles two such texts share one of their first n - ceil(n * share) + 1, n being a
text's own number of shingles; so each text files these only, with their places in the order, which
bound what two texts can share. Texts that meet are held against each other by bitmaps: where shingles
flip one bit each, at least as many shingles differ as bits do. What both bounds let through
is verified on all shingles. No link is missed. The order puts shingles that a sample of texts shares
last, which keeps buckets small; results do not depend on it.

Texts are verified in two rounds. First each meets the texts that its fingerprint is linked to, and the least
and greatest texts of its buckets, a few of them, so that a large group of near copies costs in proportion to its size. Then texts that are still
in another component than most of their bucket meet all of the bucket but their own component. Many
unlike texts in one bucket still cost their pairs; none is dropped.

Defined results: texts without words, null among them, are copies of each other; fewer words than a
shingle make one shingle; an empty table gives an empty table; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm import simhash
from textwarden.llm.common import discard, materialize, slices, tidied
from textwarden.llm.components import components

SHINGLE = 5
#: Least similarity, as a fraction.
SHARE = (4, 5)
SEED = 42
#: Least bits of the map that texts are held against each other by, and bits for each shingle of longer
#: texts; results do not depend on them.
LEAST_BITS = 256
BITS_EACH = 2
#: Bytes of text that a worker turns into shingles at a time.
SLICE_BYTES = 1_000_000
#: Texts that the order of shingles looks at, and shingles that it sets back; results do not depend on them.
SAMPLE = 16384
MOST_COMMON = 100_000

#: Ids of texts to verify that are broadcast, some 16 bytes each; where there are more the join shuffles.
BROADCAST_IDS = 1_000_000
#: Ends of buckets that a text meets in the first round, those that it shares most buckets with; results do
#: not depend on it.
ENDS = 4
#: Parts that pairs are verified in; results do not depend on it.
ROUNDS = 2

FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, in ascending order of their unsigned values."""
    values = np.array([xxhash.xxh64_intdigest(w, SEED) for w in (text or "").encode().lower().split()], np.uint64)
    count = max(1, len(values) - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(min(size, len(values))):
        out = (out ^ (out >> np.uint64(29))) * FACTOR + values[k : k + count]
    out = (out ^ (out >> np.uint64(31))) * MIX
    return np.unique(out ^ (out >> np.uint64(27)))


def least_shared(n: int) -> int:
    """Shingles that a text with n of them shares with each text that is similar to it."""
    return -(-n * SHARE[0] // SHARE[1])


def prefix(found: np.ndarray, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The shingles that a text files: common has those to set back, in order, and seen how far."""
    rank = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, seen[at], 0)
    return found[np.lexsort((found, rank))[: len(found) - least_shared(len(found)) + 1]]


def bitmap(found: np.ndarray) -> np.ndarray:
    """Bits as signed numbers, each telling whether an odd number of the shingles falls to it.

    Their number is a power of two; the halves of a map, one upon the other, are the map of half the bits.
    """
    bits = LEAST_BITS
    while bits < BITS_EACH * len(found):
        bits *= 2
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(bits: str, other: str) -> Column:
    """A map with half the bits if it has twice those of the other."""
    half = (F.size(bits) / 2).cast("int")
    upon = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > F.size(other), upon).otherwise(F.col(bits))


def _mapped(texts: DataFrame, made: str, make) -> DataFrame:
    """What make gives of ids, docs and texts: a batch of id, doc and the columns made."""
    kind = dict(texts.dtypes)["doc"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in slices(batch.column(2), SLICE_BYTES):
                ids, docs, ts = (c.slice(a, b - a) for c in batch.columns)
                yield make(ids.to_numpy(), docs, ts.to_pylist())

    return texts.select("id", "doc", "text").mapInArrow(tidied(batches), f"id long, doc {kind}, {made}")


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts hold, in order, and how many do."""
    least = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sampled = texts.join(F.broadcast(least), "id").dropDuplicates(["id"])

    def make(ids: np.ndarray, docs: pa.Array, ts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), docs, pa.array([shingles(t).view(np.int64) for t in ts], pa.list_(pa.int64()))], ["id", "doc", "s"])

    each = _mapped(sampled, "s array<long>", make).select(F.explode("s").alias("h"))
    shared = each.groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(MOST_COMMON)
    counts = {r["h"]: r["count"] for r in shared.collect()}
    order = sorted(counts, key=lambda h: h % (1 << 64))
    return np.array(order, np.int64).view(np.uint64), np.array([counts[h] for h in order], np.int64)


def sketches(texts: DataFrame) -> DataFrame:
    """id, doc, n (its number of shingles), fp (its fingerprint), bits (its bitmap) and heads (the shingles it files) of each distinct text.

    doc is of one of the rows that have the text. A task emits a text's copies once, so a group of copies brings no more rows than tasks to a shuffle.
    """
    common, seen = common_shingles(texts)
    met: set[int] = set()  # of one task, as each gets its own copy

    def make(ids: np.ndarray, docs: pa.Array, ts: list) -> pa.RecordBatch:
        rows = [(i, d, shingles(t), simhash.fingerprint(t, SHINGLE)) for i, d, t in zip(ids.tolist(), docs.to_pylist(), ts) if i not in met and not met.add(i)]
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _, _, _ in rows], pa.int64()),
            pa.array([d for _, d, _, _ in rows], docs.type),
            pa.array([len(s) for _, _, s, _ in rows], pa.int32()),
            pa.array(np.array([fp for _, _, _, fp in rows], np.uint64).view(np.int64)),
            pa.array([bitmap(s) for _, _, s, _ in rows], kind),
            pa.array([prefix(s, common, seen).view(np.int64) for _, _, s, _ in rows], kind),
        ], ["id", "doc", "n", "fp", "bits", "heads"])

    return _mapped(texts, "n int, fp long, bits array<long>, heads array<long>", make).dropDuplicates(["id"])


def _enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether so many shared shingles make texts of n and m shingles similar."""
    return shared.cast("long") * sum(SHARE) >= (n + m).cast("long") * SHARE[0]


def _near(n: str, m: str, bits: str, other: str) -> Column:
    """Whether texts may be similar by their numbers of shingles and their maps."""
    # maps of similar texts have at most one power of two between them
    apart = F.aggregate(F.zip_with(_folded(bits, other), _folded(other, bits), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = F.floor((F.col(n) + F.col(m) - apart) / 2)
    return _enough(F.least(n, m), F.col(n), F.col(m)) & F.coalesce(_enough(most, F.col(n), F.col(m)), F.lit(False))


def _sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """pairs with the columns of a's and b's rows of the table, under the names column_a and column_b."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def verified(texts: DataFrame, sketched: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts are similar.

    Shingles are as large as the texts, so pairs are verified in ROUNDS parts, one after the other.
    """
    held = _sides(pairs, sketched, "n", "bits").filter(_near("n_a", "n_b", "bits_a", "bits_b"))
    close = materialize(held.select("a", "b"), "close-pairs")

    def make(ids: np.ndarray, docs: pa.Array, ts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), docs, pa.array([shingles(t).view(np.int64) for t in ts], pa.list_(pa.int64()))], ["id", "doc", "s"])

    out = []
    for k in range(ROUNDS):
        part = close.filter(F.pmod(F.xxhash64("a"), F.lit(ROUNDS)) == k)
        ids = part.select(F.col("a").alias("id")).union(part.select("b")).distinct()
        needed = materialize(sketched.join(ids, "id", "left_semi").select(F.col("id").alias("__id"), F.col("doc").alias("__doc")), "close-texts")
        few = needed.count() <= BROADCAST_IDS
        held = texts.join(F.broadcast(needed) if few else needed, (F.col("id") == F.col("__id")) & F.col("doc").eqNullSafe(F.col("__doc")), "left_semi")
        sets = materialize(_mapped(held, "s array<long>", make), "shingle-sets")
        shared = F.size(F.array_intersect("s_a", "s_b"))
        similar = _sides(part, sets, "s").filter(_enough(shared, F.size("s_a"), F.size("s_b"))).select("a", "b")
        out.append(materialize(similar.distinct(), "similar"))
        discard(needed, sets)
    discard(close)
    return reduce(DataFrame.unionByName, out)


def _pair(x: Column | str, y: Column | str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def alike(sketched: DataFrame) -> DataFrame:
    """(a, b) of ids whose fingerprints operator 7 links, enough to connect all of them: a written table.

    A fingerprint's least id stands for it; other texts of the same fingerprint meet that one.
    """
    nodes = materialize(sketched.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("texts")), "fingerprint-nodes")
    met = simhash.buckets(nodes.select("fp"))
    same = sketched.select("id", "fp").join(nodes.filter("texts > 1"), "fp").filter("id <> least").select(*_pair("id", "least"))
    ends = [nodes.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}")) for side in ("a", "b")]
    apart = simhash.linked(met).join(ends[0], "a").join(ends[1], "b").select(*_pair("least_a", "least_b"))
    out = materialize(same.unionByName(apart).distinct(), "fingerprint-pairs")
    discard(nodes, met)
    return out


def links(texts: DataFrame) -> DataFrame:
    """(a, b) of the ids of similar texts, enough to connect all of them.

    texts has the columns id, equal for equal texts only, doc and text; it is read more than once.
    """
    sketched = materialize(sketches(texts), "text-sketches")
    printed = alike(sketched)
    entries = sketched.select("id", "n", F.posexplode("heads").alias("at", "h"))
    shared = entries.groupBy("h").count().filter("count > 1").select("h")
    met = materialize(entries.join(shared, "h"), "shingle-buckets")
    ends = met.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("greatest"))
    ends = met.join(ends, "h").select("id", F.explode(F.array("least", "greatest")).alias("end")).filter("id <> end").groupBy("id", "end").count()
    # which ends a text meets does not matter, as the second round is exact whatever the first finds
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "end"))
    first = ends.withColumn("rank", rank).filter(F.col("rank") <= ENDS).select(*_pair("id", "end"))
    first = materialize(first.unionByName(printed).distinct(), "similar-pairs")
    discard(printed)
    near = verified(texts, sketched, first)

    parts = components(near, "a", "b").withColumnRenamed("node", "id")
    placed = materialize(met.join(parts, "id", "left").select("h", "id", "n", "at", F.coalesce("component", "id").alias("part")), "placed")
    tally = placed.groupBy("h", "part").count().groupBy("h").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("count", "part")).alias("most"))
    split = placed.join(tally.filter("parts > 1"), "h").drop("parts").join(sketched.select("id", "bits"), "id")
    split = materialize(split, "split-buckets")
    outside = split.filter("part <> most").drop("most")
    every = split.select("h", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("bits").alias("bits_b"), F.col("part").alias("part_b"), (F.col("part") == F.col("most")).alias("usual"))
    # of two texts outside, the lesser meets the greater
    meeting = (F.col("part") != F.col("part_b")) & (F.col("usual") | (F.col("id") < F.col("b")))
    reach = _enough(F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")), F.col("n"), F.col("n_b"))
    rest = outside.withColumnRenamed("h", "own").join(every, (F.col("own") == F.col("h")) & meeting & reach & _near("n", "n_b", "bits", "bits_b"))
    rest = materialize(rest.select(*_pair("id", "b")).distinct().join(first, ["a", "b"], "left_anti"), "similar-pairs")
    more = None if rest.isEmpty() else verified(texts, sketched, rest)
    discard(sketched, met, first, placed, split, rest)
    return near if more is None else near.unionByName(more)


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df, all columns unchanged, with one row of each component of similar texts.

    The smallest doc_id stays; of its rows, or where no row has a doc_id, the one whose text has the
    least hash.
    """
    key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    texts = df.select(key.alias("id"), F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = materialize(df.select(F.col(doc_id).alias("doc"), key.alias("id")).groupBy("doc", "id").count(), "text-keys")
    linked = components(links(texts), "a", "b").withColumnRenamed("node", "id")
    placed = materialize(rows.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")), "text-groups")
    order = F.struct(F.col("doc").isNull(), "doc", "id")
    first = placed.groupBy("component").agg(F.min_by(F.struct("doc", "id"), order).alias("first"))
    judged = placed.join(first, "component").withColumn("stays", F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("id") == F.col("first.id")))
    judged = materialize(judged.select("doc", "id", "count", "stays"), "text-verdicts")
    same = F.col(doc_id).eqNullSafe(F.col("__doc")) & (key == F.col("__id"))
    named = [F.col("doc").alias("__doc"), F.col("id").alias("__id")]
    kept = df.join(judged.filter("NOT stays").select(*named), same, "left_anti")
    repeated = judged.filter("stays AND count > 1").select(*named)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, same, "left_anti")
    again = kept.join(repeated, same, "left_semi").withColumn("__key", key).dropDuplicates([doc_id, "__key"]).drop("__key")
    return once.unionByName(again)

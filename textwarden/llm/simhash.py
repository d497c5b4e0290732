"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint is the bitwise majority of the XXH64 values of its shingles. Distinct
fingerprints are linked where at most ``distance`` bits differ. The bits are dealt into parts,
correlated bits together, and each part gets its own threshold of -1 (not searched) or more, whose
sum is distance - parts + 1: any two fingerprints within the distance then agree within the
threshold of some part. Dynamic programming over counts estimated from a sample picks the
thresholds. Each fingerprint files its parts' values and probes those within the threshold; pairs
that meet are verified on all bits.

Copies collapse to one fingerprint first. A bucket whose pairs would exceed BUCKET_PAIRS emits none:
its fingerprints file all values within one bit of their own, and two fingerprints at most two bits
apart share one such value, which has at most 65 takers; linking the takers in a star is as exact as
all pairs and linear. No link is dropped.

Defined results: null texts and texts without words have fingerprint zero, linked like any other;
fewer words than a shingle make one shingle; repeated rows share their component; a row without
doc_id gets the component of its fingerprint, null if no document there has an id; an empty table
gives an empty table; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import materialize, slices, tidied
from textwarden.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Two parts of 32 bits keep buckets sparse up to billions of fingerprints.
PARTS = 2
BUCKET_PAIRS = 4096
#: Fingerprints that the cost estimate looks at; results do not depend on it.
SAMPLE = 4096
#: A pair that meets costs so many probes.
PAIR_COST = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(g) for g in zip(*[words[k:] for k in range(shingle)])] or [b" ".join(words)]
    digest, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for a in range(0, len(grams), 8192):
        packed = b"".join([digest(g, SEED) for g in grams[a : a + 8192]])
        total += np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(grams)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The columns of keep and fp, the fingerprint as a signed long."""
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = source.drop("__text").selectExpr("*", "0L AS fp").schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: list[int] = []
            for a, b in slices(batch.columns[-1]):
                found += [fingerprint(t, shingle) for t in batch.columns[-1].slice(a, b - a).to_pylist()]
            signed = pa.array(np.array(found, np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], signed], names=[*keep, "fp"])

    return source.mapInArrow(tidied(batches), schema)


def correlated_parts(sample: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bit numbers (0: least) in parts of equal size, each grown from a bit by strongest correlation."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    spread = np.maximum(bits.std(axis=0), 1e-9) if len(bits) else np.ones(BITS)
    z = (bits - bits.mean(axis=0)) / spread if len(bits) else np.zeros((1, BITS))
    strength = np.abs(z.T @ z) / max(1, len(z))
    np.fill_diagonal(strength, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        part = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (strength[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def mask_of(part: Sequence[int]) -> int:
    return sum(1 << b for b in part)


def flips(part: Sequence[int], radius: int) -> list[int]:
    """Nonempty sets of at most radius bits of the part, as masks."""
    return [mask_of(c) for r in range(1, radius + 1) for c in combinations(part, r)]


def thresholds(parts: Sequence[Sequence[int]], sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[int]:
    """The cheapest thresholds with the sum that the principle needs, by dynamic programming."""
    n = len(sample)
    grow = (total / n) ** 2 if n else 0
    cost: list[dict[int, float]] = []
    for part in parts:
        own = sample & np.uint64(mask_of(part))
        met = np.zeros(distance + 1)
        for a in range(0, n, 512):
            apart = np.bitwise_count(own[a : a + 512, None] ^ own[None])
            met += [(apart <= t).sum() for t in range(distance + 1)]
        pairs = np.maximum(met - n, 0) / 2
        cost.append({-1: 0.0} | {t: total * (1 + len(flips(part, t)) / 2) + PAIR_COST * pairs[t] * grow for t in range(distance + 1)})
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t, extra in options.items():
                if spent + t + 1 <= distance + 1 and ((key := spent + t + 1) not in step or c + extra < step[key][0]):
                    step[key] = (c + extra, [*chosen, t])
        best = step
    return best[distance + 1][1]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _filed(part_no: int, part: Sequence[int], radius: int) -> Column:
    """Array of (part, value, probe): the part's own value, and each value that the fingerprint probes.

    Of two fingerprints that differ in a part, only the one whose lowest differing bit is unset
    probes the other, so half the flips do.
    """
    mask = _signed(mask_of(part))
    own = F.array(F.struct(F.lit(part_no).alias("part"), F.col("fp").bitwiseAND(mask).alias("value"), F.lit(False).alias("probe")))
    sets = flips(part, radius)
    if not sets:
        return own
    entries = F.array(*[F.struct(_signed(s).alias("flip"), _signed(s & -s).alias("low")) for s in sets])
    unset = F.filter(entries, lambda e: F.col("fp").bitwiseAND(e["low"]) == 0)
    probes = F.transform(unset, lambda e: F.struct(F.lit(part_no).alias("part"), F.col("fp").bitwiseXOR(e["flip"]).bitwiseAND(mask).alias("value"), F.lit(True).alias("probe")))
    return F.concat(own, probes)


def buckets(distinct: DataFrame, distance: int = DISTANCE, parts: int = PARTS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """fp, part, value, probe and crowded of what fingerprints file and probe, where another meets it: a written table.

    distinct has the column fp and should be a written table, as it is read more than once.
    """
    if distance > 2:
        raise ValueError("crowded buckets are linked exactly up to a distance of 2")
    total = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    dealt = correlated_parts(sample, parts)
    chosen = thresholds(dealt, sample, total, distance)
    filed = F.concat(*[_filed(k, p, t) for k, (p, t) in enumerate(zip(dealt, chosen)) if t >= 0])
    keys = distinct.select("fp", F.explode(filed).alias("k")).select("fp", "k.*")

    sizes = keys.groupBy("part", "value").agg(F.count_if(~F.col("probe")).alias("own"), F.count(F.lit(1)).alias("n"))
    shared = sizes.filter("own > 0 AND n > 1").select("part", "value", (F.col("own") * F.col("n") > bucket_pairs).alias("crowded"))
    return materialize(keys.join(shared, ["part", "value"]), "simhash-buckets")


def linked(met: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of fingerprints in the buckets at most distance bits apart, enough to connect all such pairs."""
    few = met.filter("NOT crowded")
    x = few.filter("NOT probe").select("part", "value", F.col("fp").alias("a"))
    y = few.select("part", "value", F.col("fp").alias("b"), "probe")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = x.join(y, ["part", "value"]).filter((F.col("probe") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & near).select("a", "b")

    around = F.array(F.lit(0).cast("long"), *[_signed(1 << b) for b in range(BITS)])
    crowded = met.filter("crowded").select("fp").distinct()
    takers = crowded.select("fp", F.explode(F.transform(around, lambda f: F.col("fp").bitwiseXOR(f))).alias("middle"))
    stars = takers.groupBy("middle").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    spokes = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(spokes)


def links(distinct: DataFrame, distance: int = DISTANCE, parts: int = PARTS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(a, b) of distinct fingerprints at most distance bits apart, enough to connect all such pairs."""
    return linked(buckets(distinct, distance, parts, bucket_pairs), distance)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE, parts: int = PARTS, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) for every row."""
    printed = materialize(fingerprints(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    nodes = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    linked = materialize(components(links(nodes.select("fp"), distance, parts, bucket_pairs), "a", "b"), "components")
    least = nodes.join(linked, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "component").select("node", "component_id")
    placed = nodes.join(moved, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return printed.join(placed, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

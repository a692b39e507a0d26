"""SimHash near-duplicates by the generalised pigeonhole principle.

If the 64 bits are cut into m partitions with thresholds t_i that sum to
tau - m + 1, any two fingerprints within tau bits agree in some partition to
within its t_i.  Bits that go together are put into one partition, and the
thresholds (-1: the partition isn't used) are allocated by dynamic
programming over the estimated costs of probes and candidates.  Each
fingerprint probes the values within t_i of its own and matches are verified.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_texts
from .graph import components

BITS = 64
SHINGLE_WORDS = 4
MOST_BITS = 4
#: Cost of a verified candidate against that of a shuffled probe.
VERIFY_COST = 0.05
#: A partition's ball may have so many values: a bound on the plan's size, met by two partitions for any tau up to 6.
MOST_PROBES = 6_000
SAMPLE_ROWS, SAMPLE_PAIRS = 8_192, 400_000


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a whole text; 0 if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - shingle_words + 1)
    digest, size = xxhash.xxh64_digest, min(shingle_words, len(words))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        raw = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts[at:to], starts[at + size : to + size], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame, *, shingle_words: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp long`` (the fingerprint's bits as a signed number) for every row; null and wordless texts have 0."""

    def each(keys, texts):
        return keys, pa.array(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64))

    kind = documents.select(key).schema[0].dataType.simpleString()
    return map_texts(documents, each, f"doc_id {kind}, fp long", key=key, text=text)


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def errors(self) -> list[int]:
        """All differences of at most ``threshold`` bits within the partition."""
        return [sum(1 << b for b in some) for k in range(self.threshold + 1) for some in combinations(self.bits, k)]


def ball(width: int, threshold: int) -> int:
    return sum(comb(width, k) for k in range(threshold + 1))


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, how many have both: 64 x 64 sums over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), 1 << 14):
                bits = np.unpackbits(raw[at : at + (1 << 14)], axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], names=["place", "n"])

    rows = prints.select("fp").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for place, n in rows:
        flat[place] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m partitions of nearly equal width; each grows from the least bit left by the bit that goes most with its own."""
    share = both / max(1, n)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        own = [left.pop(0)]
        while len(own) < width:
            best = max(left, key=lambda b: (round(float(related[b, own].sum()), 6), -b))
            left.remove(best)
            own.append(best)
        out.append(tuple(sorted(own)))
    return out


def sampled_pairs(prints: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Differing bits of pairs within a bounded sample of fingerprints (those with the least hash), from which candidates are estimated; results don't depend on it."""
    got = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(rows).toArrow().column("fp").to_numpy().view(np.uint64)
    if len(got) < 2:
        return np.zeros(0, np.uint64)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, len(got), (2, SAMPLE_PAIRS))
    return (got[a] ^ got[b])[a != b]


def allocate(n: int, both: np.ndarray, tau: int = MOST_BITS, pairs: np.ndarray | None = None) -> list[Partition]:
    """The cheapest partitions and thresholds for n fingerprints.

    The share of pairs within a threshold of a partition is that of independent
    bits or that of the sampled ``pairs``, whichever is greater: bits that go
    together are grouped, and agree far more often than independent ones.
    """
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[Partition]] = (float("inf"), [])
    for m in range(1, tau + 2):
        groups = group_bits(n, both, m)
        costs = []
        for bits in groups:
            chance = np.zeros(tau + 2)
            chance[0] = 1.0
            for b in bits:  # of so many differing bits
                chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
                chance[0] *= 1 - differ[b]
            within = np.cumsum(chance)
            if pairs is not None and len(pairs):
                apart_by = np.bitwise_count(pairs & np.uint64(Partition(bits, 0).mask))
                within = np.maximum(within, np.cumsum(np.bincount(apart_by, minlength=BITS + 1))[: tau + 2] / len(pairs))
            costs.append([0.0] + [n * ball(len(bits), t) + VERIFY_COST * n * n / 2 * within[t] if ball(len(bits), t) <= MOST_PROBES else float("inf") for t in range(tau + 1)])
        ways: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:
            now: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (c, chosen) in ways.items():
                for t in range(-1, tau + 1):
                    way = (c + cost[t + 1], (*chosen, t))
                    if total + t not in now or way < now[total + t]:
                        now[total + t] = way
            ways = now
        c, chosen = ways.get(tau - m + 1, (float("inf"), ()))
        if c < best[0]:
            best = (c, [Partition(b, t) for b, t in zip(groups, chosen, strict=True)])
    return [x for x in best[1] if x.threshold >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def apart(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, parts: list[Partition], tau: int = MOST_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints that join all that are within ``tau`` bits.

    ``prints(fp, copies)`` are distinct.  In each bucket the most copied value
    is the hub: every prober within ``tau`` of it gets that link, and two values
    that both have it are neither linked nor compared, so a dense group of n
    values costs about n comparisons and not all its pairs.
    """
    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(signed(p.mask)).alias("mask")) for i, p in enumerate(parts)))
    tries = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(signed(p.mask)).alias("mask"), F.lit(signed(e)).alias("error")) for i, p in enumerate(parts) for e in p.errors()))
    index = prints.select(F.col("fp").alias("b"), "copies", F.inline(keys)).select("part", F.col("b").bitwiseAND(F.col("mask")).alias("value"), "b", "copies")
    hubs = index.groupBy("part", "value").agg(F.max(F.struct("copies", "b")).alias("top")).select("part", "value", F.col("top.b").alias("hub"))
    probes = prints.select(F.col("fp").alias("a"), F.inline(tries)).select("part", F.col("a").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("error")).alias("value"), "a")
    probes = probes.join(hubs, ["part", "value"]).withColumn("near", apart("a", "hub") <= tau)
    index = index.select("part", "value", "b").join(hubs, ["part", "value"]).withColumn("near", apart("b", "hub") <= tau)
    to_hub = probes.filter(F.col("near") & (F.col("a") != F.col("hub"))).select("a", F.col("hub").alias("b"))
    # members near the hub and probers near it never meet: the side says whom a prober meets
    asking = probes.select("part", "value", "near", "a")
    asked = index.filter("b <> hub").select("part", "value", "b", F.explode(F.when(F.col("near"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("near"))
    rest = asking.join(asked, (asking["part"] == asked["part"]) & (asking["value"] == asked["value"]) & (asking["near"] == asked["near"]) & (F.col("a") < F.col("b")) & (apart("a", "b") <= tau))
    return to_hub.unionByName(rest.select("a", "b"))


def near_duplicates(documents: DataFrame, *, tau: int = MOST_BITS, shingle_words: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``, the least doc_id reachable over links of at most ``tau`` bits.

    Null and wordless texts have fingerprint 0 and are linked like any other.
    Repeated rows have equal fingerprints and so one component; a row with a
    null key keeps it and takes the component of its fingerprint (null if
    none of its members has a key); an empty table gives an empty table; other
    columns are not read.
    """
    rows = checkpoint(fingerprints(documents, shingle_words=shingle_words, key=key, text=text))
    prints = checkpoint(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")))
    n, both = bit_counts(prints)
    found = components(links(prints, allocate(n, both, tau, sampled_pairs(prints)), tau)) if n else None
    if found is None:
        return rows.select("doc_id", "fp", F.col("doc_id").alias("component_id"))
    labelled = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    lowest = checkpoint(labelled.groupBy("label").agg(F.min("least").alias("component_id")))  # apart from the join, so that a hot label can be split there
    return rows.join(labelled.join(lowest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, *, tau: int = MOST_BITS, shingle_words: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the least key, with all columns; one row of each key."""
    found = checkpoint(near_duplicates(documents, tau=tau, shingle_words=shingle_words, key=key, text=text).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")))
    kept = found.groupBy("_kept").agg(F.count("*").alias("_rows"))
    out = documents.join(kept.select("_kept"), documents[key].eqNullSafe(F.col("_kept")), "left_semi")
    return out.dropDuplicates([key]) if kept.filter("_rows > 1").head(1) else out


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

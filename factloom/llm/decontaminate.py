"""Benchmark decontamination: the q-gram lemma over diagonal bands, then banded alignment.

An item of n characters that occurs with at most e edits keeps n - q + 1 - q e
of its q-grams, on diagonals that lie within e of each other.  Shared q-grams
of a document and an item are counted in bands of 2 (e + 1) diagonals that
overlap by half; regions that reach the bound are verified by an alignment
that only fills the band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_texts, map_texts

Q = 10
#: Edits that an occurrence may have, as a share of the item's normalised length.
EDIT_SHARE = 0.08
#: Items are searched in blocks of at most so many characters: the bound of what is broadcast at once.
BLOCK_ITEM_CHARS = 4_000_000
#: A q-gram that makes more pairs of a spot in the text and a place in an item is counted by bands instead; the result is the same.
MANY_PAIRS = 20_000
_HASH_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    """Lower case of single code points below U+0590, white space as blank; others stay."""
    out = np.arange(0x590, dtype=np.uint32)
    for c in range(0x590):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
        if chr(c).isspace():
            out[c] = 32
    return out


_FOLD = _fold_table()


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with white-space runs as one blank, none at the ends; and the place of each in the text."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(chars < len(_FOLD), _FOLD[np.minimum(chars, len(_FOLD) - 1)], chars)
    blank = low == 32
    keep = ~blank
    if len(keep) > 1:
        keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    if len(at) and low[at[-1]] == 32:
        at = at[:-1]
    return low[at], at


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of every run of q code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, done, out, part = 1, 0, np.zeros(n, np.uint64), codes.astype(np.uint64) * _ODD ^ (codes.astype(np.uint64) >> np.uint64(7))
        while True:  # hashes of runs of 1, 2, 4 ... put together to q
            if q & power:
                out = out * np.uint64(pow(0x100000001B3, power, 1 << 64)) + part[done : done + n]
                done += power
            power *= 2
            if power > q:
                return out * _ODD
            half = power // 2
            part = part[:-half] * np.uint64(pow(0x100000001B3, half, 1 << 64)) + part[half:]


@dataclass
class Item:
    number: int
    item_id: object
    codes: np.ndarray
    edits: int
    least: int  # shared q-grams that an occurrence has


class Searcher:
    """Finds a block of benchmark items in texts."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, share: float = EDIT_SHARE):
        self.q, self.items, self.whole = q, [], {}
        grams, owners, places = [], [], []
        for item_id, text in items:
            codes, _ = normalise(text or "")
            if len(codes) < q:
                if len(codes):
                    self.whole.setdefault(codes.tobytes(), []).append(item_id)
                continue
            edits = min(int(share * len(codes)), (len(codes) - q) // q)
            item = Item(len(self.items), item_id, codes, edits, len(codes) - q + 1 - q * edits)
            self.items.append(item)
            h = gram_hashes(codes, q)
            grams.append(h)
            owners.append(np.full(len(h), item.number, np.int64))
            places.append(np.arange(len(h), dtype=np.int64))
        joined = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.grams = joined[order]
        self.owner = np.concatenate(owners)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if grams else np.zeros(0, np.int64)
        self.maybe = np.zeros(1 << _HASH_BITS, bool)
        self.maybe[(self.grams >> np.uint64(64 - _HASH_BITS)).astype(np.int64)] = True
        self.edits = np.array([x.edits for x in self.items], np.int64)
        self.least = np.array([x.least for x in self.items], np.int64)

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """``(item id, start, end, edits)`` of the occurrences in a text, in its code points."""
        codes, at = normalise(text)
        found = [(i, int(at[0]), int(at[-1]) + 1, 0) for i in self.whole.get(codes.tobytes(), [])] if self.whole and len(codes) < self.q else []
        h = gram_hashes(codes, self.q)
        spots = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _HASH_BITS)).astype(np.int64)]) if len(h) and len(self.grams) else np.zeros(0, np.int64)
        if len(spots):
            lo = np.searchsorted(self.grams, h[spots], "left")
            n = np.searchsorted(self.grams, h[spots], "right") - lo
            spots, lo, n = spots[n > 0], lo[n > 0], n[n > 0]
        if len(spots):
            last: dict[int, tuple[object, int, int, int]] = {}  # of each item, the occurrence before
            for region in self.regions(spots, lo, n):
                number, _, high = region
                before = last.get(number)
                if before and high + self.items[number].edits < before[2]:
                    continue  # all that this band can give begins inside it
                hit = self.verify(codes, *region)
                if not hit:
                    continue
                if before and hit[1] < before[2]:
                    if hit[3] < before[3]:
                        last[number] = hit
                    continue
                if before:
                    found.append((before[0], int(at[before[1]]), int(at[before[2] - 1]) + 1, before[3]))
                last[number] = hit
            found += [(i, int(at[start]), int(at[end - 1]) + 1, edits) for i, start, end, edits in last.values()]
        return sorted(set(found), key=lambda x: (x[1], x[2], str(x[0])))

    def regions(self, spots: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, least and greatest diagonal) of the bands that hold enough different q-grams of an item, by item and diagonal."""
        order = np.argsort(lo, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(lo[order]) > 0))
        times = np.diff(np.append(first, len(order)))
        many = times * n[order][first] > MANY_PAIRS
        out: list[tuple[int, int, int]] = []
        if many.any():
            spots_of = {int(lo[order][a]): spots[order][a : a + k] for a, k in zip(first.tolist(), times.tolist(), strict=True)}
            heavy = np.unique(np.concatenate([self.owner[lo[order][a] : lo[order][a] + n[order][a]] for a in first[many].tolist()]))
            for i in heavy.tolist():
                out += self._repeated(i, spots_of)
            # all items of a many-paired gram are among these, so it goes as a whole
            keep = np.empty(len(lo), bool)
            keep[order] = ~np.repeat(many, times)
            spots, lo, n = spots[keep], lo[keep], n[keep]
        every = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        spot = np.repeat(spots, n)
        if many.any():
            other = ~np.isin(self.owner[every], heavy)
            every, spot = every[other], spot[other]
        item, place = self.owner[every], self.place[every]
        diagonal = spot - place
        width = self.edits[item] + 1
        low = np.floor_divide(diagonal, width)
        key_item, key_band, key_place = np.concatenate([item, item]), np.concatenate([low, low - 1]), np.concatenate([place, place])
        order = np.lexsort((key_place, key_band, key_item))
        i, b, p = key_item[order], key_band[order], key_place[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])
        i, b = i[new], b[new]
        first = np.ones(len(i), bool)
        first[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(i)))
        for s in starts[counts >= self.least[i[starts]]]:
            w = int(self.edits[i[s]]) + 1
            out.append((int(i[s]), int(b[s]) * w, int(b[s]) * w + 2 * w - 1))
        return out

    def _repeated(self, number: int, spots_of: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
        """The bands of one item whose q-grams occur many times over: places are counted by band, and no pair of a spot and a place is made."""
        item = self.items[number]
        w, h = item.edits + 1, gram_hashes(item.codes, self.q)
        base = -(len(h) // w) - 2
        top = max(int(x[-1]) for x in spots_of.values()) // w + 2
        counts = np.zeros(top - base + 1, np.int32)
        for gram in np.unique(h).tolist():
            spots = spots_of.get(int(np.searchsorted(self.grams, np.uint64(gram))))
            if spots is None:
                continue
            places = np.flatnonzero(h == np.uint64(gram))
            for r in np.unique(places % w).tolist():
                low = np.unique(np.floor_divide(spots - r, w))
                bands = np.union1d(low, low - 1) - base
                for k in (places[places % w == r] // w).tolist():
                    counts[bands - k] += 1
        return [(number, b * w, b * w + 2 * w - 1) for b in (np.flatnonzero(counts >= item.least) + base).tolist()]

    def verify(self, codes: np.ndarray, number: int, low: int, high: int) -> tuple[object, int, int, int] | None:
        item = self.items[number]
        n = len(item.codes)
        for d in range(max(0, low), min(high, len(codes) - n) + 1) if item.edits < 4 else _likely(codes, item.codes, low, high):
            if np.array_equal(codes[d : d + n], item.codes):
                return item.item_id, d, d + n, 0
        hit = banded(item.codes, codes, low - item.edits, high + item.edits, item.edits)
        return (item.item_id, *hit) if hit else None


def _likely(codes: np.ndarray, item: np.ndarray, low: int, high: int) -> list[int]:
    """Diagonals of a band on which the item's first and last characters agree."""
    lo, hi = max(0, low), min(high, len(codes) - len(item))
    if hi < lo:
        return []
    same = (codes[lo : hi + 1] == item[0]) & (codes[lo + len(item) - 1 : hi + len(item)] == item[-1])
    return (np.flatnonzero(same) + lo).tolist()


def banded(item: np.ndarray, codes: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The best alignment of the whole item to a stretch of ``codes`` within a band of diagonals, free at the text's ends.

    ``(start, end, edits)`` with the fewest edits (ties: the least end, then
    the greatest start), or None if it takes more than ``most`` or the stretch would be empty.
    """
    width, n, big = high - low + 1, len(item), 1 << 20
    diagonals = np.arange(low, high + 1)
    inside = (diagonals >= 0) & (diagonals <= len(codes))
    # a cell holds edits * 2**32 - start, so the least is the fewest edits, then the latest start
    unit = np.int64(1) << np.int64(32)
    row = np.where(inside, -diagonals.astype(np.int64), big * unit)
    steps = np.arange(width, dtype=np.int64) * unit
    padded = np.full(n + width + 1, np.uint32(0xFFFFFFFF))
    lo, hi = max(0, low), min(len(codes), high + n)
    if hi > lo:
        padded[lo - low : hi - low] = codes[lo:hi]
    for i in range(n):
        ends = diagonals + i + 1
        sub = row + np.where(padded[i : i + width] == item[i], 0, unit)
        sub[(ends < 1) | (ends > len(codes))] = big * unit
        gap = np.append(row[1:], big * unit) + unit
        gap[(ends < 0) | (ends > len(codes))] = big * unit
        best = np.minimum(sub, gap)
        row = np.minimum.accumulate(best - steps) + steps
        row[(ends < 0) | (ends > len(codes))] = big * unit
    edits = -(-row // unit)
    k = int(edits.argmin())
    e = int(edits[k])
    start, end = int(e * int(unit) - int(row[k])), int(diagonals[k]) + n
    return (start, end, e) if e <= most and end > start else None


def item_blocks(benchmark: DataFrame, *, key: str = "item_id", text: str = "text", most: int = BLOCK_ITEM_CHARS):
    """The benchmark's distinct items in blocks of at most ``most`` characters (one item at least), read one partition at a time."""
    block, held = [], 0
    for item_id, body in benchmark.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull()).distinct().orderBy(key, text).toLocalIterator():
        if block and held + len(body) > most:
            yield block
            block, held = [], 0
        block.append((item_id, body))
        held += len(body)
    if block:
        yield block


def occurrences(documents: DataFrame, benchmark: DataFrame, *, q: int = Q, share: float = EDIT_SHARE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per occurrence of a benchmark item in a document: ``doc_id, item_id, start, end, edits`` (code points, end exclusive).

    Case, and the amount of white space, make no difference.  An item of n
    normalised characters may differ by ``share`` of n edits, and by no more
    than (n - q) / q, so that the lemma's bound holds.  Items shorter than q
    match only a document that is nothing else; null and blank items match
    nothing; null and empty texts hold nothing.  Occurrences of one item don't
    overlap: from the left, of two that do the one with fewer edits stays.  Equal occurrences of one document are one row;
    a repeated document repeats its rows.  Empty tables give no rows; other columns are not read.
    """
    kind = documents.select(F.col(key)).schema[0].dataType.simpleString()
    item_kind = benchmark.select(F.col(item_key)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, found array<struct<item_id:{item_kind},start:int,end:int,edits:int>>"
    out = None
    for block in item_blocks(benchmark, key=item_key, text=item_text):
        shared = documents.sparkSession.sparkContext.broadcast(block)
        part = map_texts(documents, _finder(shared, q, share), schema, key=key, text=text).select("doc_id", F.inline("found"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.select(F.col(key).alias("doc_id")).limit(0).select("doc_id", F.lit(None).cast(item_kind).alias("item_id"), *(F.lit(0).alias(c) for c in ("start", "end", "edits")))
    return out


def _finder(shared, q: int, share: float):
    held: list[Searcher] = []

    def each(keys, texts):
        if not held:
            held.append(Searcher(shared.value, q, share))
        return keys, [[dict(zip(("item_id", "start", "end", "edits"), hit, strict=True)) for hit in held[0].find(t)] for t in texts]

    return each


def clean(documents: DataFrame, benchmark: DataFrame, *, q: int = Q, share: float = EDIT_SHARE, text: str = "text") -> DataFrame:
    """The documents without an occurrence of any item, with all their columns; nothing is shuffled."""
    for block in item_blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(block)
        documents = keep_texts(documents, _without(shared, q, share), text=text)
    return documents


def _without(shared, q: int, share: float):
    held: list[Searcher] = []

    def wanted(texts: list[str]) -> list[bool]:
        if not held:
            held.append(Searcher(shared.value, q, share))
        return [not held[0].find(t) for t in texts]

    return wanted

"""Byte-pair encoding and decoding through a minimal acyclic transducer lexicon.

The corpus's most frequent words are compiled, with their ids as output, into
a shared-suffix automaton: equal suffix subgraphs exist once, and the outputs
along a path add up to the word's number, which leads to its ids.  The automaton is a
flat buffer that every worker memory-maps.  Words outside it are merged
exactly, pair by pair.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
from array import array
from collections import Counter
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORD_CHARS, MEMO_WORDS, map_texts

#: Words in the compiled lexicon.  Others are merged, so the figure decides speed alone.
LEXICON_WORDS = 32_768
_SPACE = "\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPLIT_SPACE = re.compile(f"[{_SPACE}]+")
#: The tokenizer's own pattern for the pieces of a word, white space spelled out.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _SPACE + r"\p{L}\p{N}]+")
_STOPS = frozenset(".,;:!?")
_LONG = 96
_NO_RANK = 1 << 40
_TABLE_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Anything beyond stretches of code points that have long been assigned; a first look that costs little.
_UNUSUAL = re.compile("[^\0-\u0377\u1e00-\u1f15\u2010-\u2027\u2030-\u205e\u20a0-\u20b0\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


def has_newer(text: str) -> bool:
    """Whether a text has code points that Python's Unicode tables don't know, or one of the two whose combining class has changed since: the library is asked about them."""
    return bool(_UNUSUAL.search(text)) and any(c in "\u1ac3\u1ac4" or unicodedata.category(c) == "Cn" for c in set(text))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible Latin-1, else from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(0x100 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizer file whose words end in a suffix: normaliser, special tokens, vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.split_special = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        vocab = self.vocab
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        alphabet = byte_alphabet()
        self.inner = [vocab.get(c, -1) for c in alphabet]
        self.last = [vocab.get(c + self.suffix, -1) for c in alphabet]
        self.tokens = pa.array([self.strings.get(i, "") for i in range(max(self.strings) + 1)])
        self._inner, self._last = np.array(self.inner), np.array(self.last)
        ranked = sorted((rank, key, new) for key, (rank, new) in self.merges.items())
        self._keys = np.array([x[1] for x in ranked], np.uint64)
        self._new = np.array([x[2] for x in ranked])
        slots = (self._keys * _ODD >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        self._table = np.full(1 << _TABLE_BITS, -1, np.int64)  # the merge of a slot; -2 where several share it
        self._table[slots] = np.arange(len(slots))
        alike, counts = np.unique(slots, return_counts=True)
        self._table[alike[counts > 1]] = -2
        self._order = np.argsort(self._keys)
        self._sorted = self._keys[self._order]
        self.path = path

    @cached_property
    def library(self):
        """The library's own normaliser and splitter, for code points whose properties Python's tables lack."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def normalise(self, text: str) -> str:
        if not text.isascii():
            if has_newer(text):
                return self.library.normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-casing goes by code point: no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        """White-space-delimited words of a normalised text."""
        return [w for w in _SPLIT_SPACE.split(text) if w] if _ODD_SPACE.search(text) else text.split()

    def segments(self, text: str) -> list[tuple[str, int]]:
        """Ordinary stretches as (text, -1) and special tokens as ("", id)."""
        if not self.split_special or "<|" not in text and all("<|" in s for s in self.special):
            return [(text, -1)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [(text[at : m.start()], -1), ("", self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], -1)]

    def merge(self, word: str) -> list[int]:
        """The ids of a word without white space."""
        ids: list[int] = []
        for piece in self.pieces(word):
            raw = piece.encode("utf-8", "surrogatepass")
            parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            ids += self._merge_long(parts) if len(parts) > _LONG else self._merge_short(parts)
        return ids

    def pieces(self, word: str) -> list[str]:
        if word.isalpha():
            return [word]
        if not word.isascii() and has_newer(word):
            return [word[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(word)]
        return [word[:-1], word[-1]] if word[-1] in _STOPS and word[:-1].isalpha() else _PIECES.findall(word)

    def merge_many(self, words: list[str]) -> list[bytes]:
        """The ids of many words as 32-bit numbers: each round merges the best pair of every piece, the leftmost on ties."""
        number: dict[str, int] = {}
        owner_of: list[int] = []
        cuts = [0]
        for w in words:
            owner_of += [number.setdefault(p, len(number)) for p in self.pieces(w)]
            cuts.append(len(owner_of))
        if not number:
            return [b""] * len(words)
        raw = [p.encode("utf-8", "surrogatepass") for p in number]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        chars, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
        sym, owner = self._inner[chars], np.repeat(np.arange(len(raw)), sizes)
        sym[ends - 1] = self._last[chars[ends - 1]]
        done_sym, done_owner = [], []
        if (sizes > _LONG).any():
            for i in np.flatnonzero(sizes > _LONG).tolist():
                ids = self._merge_long(sym[ends[i] - sizes[i] : ends[i]].tolist())
                done_sym.append(np.array(ids)), done_owner.append(np.full(len(ids), i))
            short = (sizes <= _LONG)[owner]
            sym, owner = sym[short], owner[short]
        while len(sym):
            rank = np.full(len(sym), _NO_RANK, np.int64)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._ranks(sym[:-1], sym[1:]), _NO_RANK)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            going = least < _NO_RANK
            done_sym.append(sym[~going]), done_owner.append(owner[~going])
            at = np.flatnonzero(going & (rank == least))
            at = at[np.diff(owner[at], prepend=-1) != 0]  # the leftmost of each piece
            sym[at] = self._new[rank[at]]
            going[at + 1] = False
            sym, owner = sym[going], owner[going]
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        flat, held = sym[np.argsort(owner, kind="stable")].astype("<i4"), np.bincount(owner, minlength=len(raw))
        starts = np.cumsum(held) - held
        piece = np.array(owner_of)
        times = held[piece]
        packed = flat[np.repeat(starts[piece] - np.cumsum(times) + times, times) + np.arange(times.sum())].tobytes()
        edges = (4 * np.append(0, np.cumsum(times))[cuts]).tolist()
        return [packed[a:b] for a, b in zip(edges, edges[1:])]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slots = self._table[(keys * _ODD >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        out = np.where((slots >= 0) & (self._keys[slots] == keys), slots, _NO_RANK)
        if len(shared := np.flatnonzero(slots == -2)):
            at = np.minimum(np.searchsorted(self._sorted, keys[shared]), len(self._sorted) - 1)
            out[shared] = np.where(self._sorted[at] == keys[shared], self._order[at], _NO_RANK)
        return out

    def _merge_short(self, parts: list[int]) -> list[int]:
        get, none = self.merges.get, (1 << 60, -1)
        found = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best is none or best[1] < 0:
                break
            i = found.index(best)
            parts[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get(parts[i - 1] << 32 | parts[i], none)
            if i < len(found):
                found[i] = get(parts[i] << 32 | parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges by a heap, for words of any length."""
        get, n = self.merges.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] << 32 | parts[i + 1]))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if left >= 0 and right >= 0 and (m := get(parts[left] << 32 | parts[right])):
                    heapq.heappush(heap, (m[0], left, m[1], parts[left], parts[right]))
        return [p for p in parts if p >= 0]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of words with ids, as one buffer of little-endian 32-bit numbers.

    Header (6 numbers): states, edges, words, ids, the start state, bytes of labels (padded).  Then per state the first
    edge and whether a word ends; per edge target and output; per word the
    first id; the ids; the edges' labels as bytes.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open nodes along the last word: [ends, edges]
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            to = frozen(path.pop())
            path[-1][1].append((labels.pop(), to))

    words = sorted(entries)
    for word in words:
        shared = 0
        while shared < len(labels) and shared < len(word) and labels[shared] == word[shared]:
            shared += 1
        close(shared)
        for b in word[shared:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    close(0)
    start = frozen(path[0])
    below = [0] * len(states)
    for s, (ends, edges) in enumerate(states):  # targets are always registered first
        below[s] = ends + sum(below[t] for _, t in edges)
    first, final, target, output, label = [0], [], [], [], bytearray()
    for ends, edges in states:
        number = int(ends)
        for b, t in edges:
            label.append(b)
            target.append(t)
            output.append(number)
            number += below[t]
        first.append(len(target))
        final.append(int(ends))
    ids = [entries[w] for w in words]
    starts = np.cumsum([0, *map(len, ids)])
    label += bytes(-len(label) % 4)
    numbers = [len(states), len(target), len(words), int(starts[-1]), start, len(label), *first, *final, *target, *output, *starts.tolist(), *(i for x in ids for i in x)]
    return np.array(numbers, "<i4").tobytes() + bytes(label)


class Lexicon:
    """Looks words up in a memory-mapped transducer."""

    def __init__(self, buffer: bytes):
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(os.dup(fd), "wb") as f:
                f.write(buffer)
            self.map = mmap.mmap(fd, 0, access=mmap.ACCESS_READ)
        finally:
            os.close(fd)
            os.unlink(path)  # the mapping keeps the pages
        view = memoryview(self.map)
        states, edges, words, ids, self.start, _ = view[:24].cast("i")
        at = 24

        def take(n: int):
            nonlocal at
            part = view[at : at + 4 * n].cast("i")
            at += 4 * n
            return part

        self.first, self.final = take(states + 1), take(states)
        self.target, self.output = take(edges), take(edges)
        self.starts, self.ids = take(words + 1), take(ids)
        self.labels = at
        self.words = words

        # edges by (state, label), for many words at once
        of = np.repeat(np.arange(states), np.diff(np.frombuffer(self.first, np.int32)))
        letters = np.frombuffer(view[at : at + edges], np.uint8)
        self.keys = of.astype(np.int64) << 8 | letters
        self.to, self.adds, self.ends = (np.frombuffer(x, np.int32) for x in (self.target, self.output, self.final))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the sorted words, or -1: all words take one step along the automaton at a time."""
        out = np.full(len(words), -1, np.int64)
        if not words or not self.words:
            return out
        chars = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        left, state, total = np.arange(len(words)), np.full(len(words), self.start, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(left):
            done = sizes[left] == step
            if done.any():
                ended = done & (self.ends[state] == 1)
                out[left[ended]] = total[ended]
                left, state, total = left[~done], state[~done], total[~done]
            key = state << 8 | chars[starts[left] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            edge, left = edge[there], left[there]
            state, total = self.to[edge].astype(np.int64), total[there] + self.adds[edge]
            step += 1
        return out

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.starts[number] : self.starts[number + 1]].tobytes()


class Encoder:
    def __init__(self, path: str, lexicon: bytes | None):
        self.bpe = tokenizer(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.ids: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Keep each word's ids as 32-bit numbers: from the lexicon, else merged."""
        if self.lexicon:
            numbers = self.lexicon.numbers([w.encode("utf-8", "surrogatepass") for w in words])
            for i in np.flatnonzero(numbers >= 0).tolist():
                self.ids[words[i]] = self.lexicon.ids_of(int(numbers[i]))
            words = [words[i] for i in np.flatnonzero(numbers < 0).tolist()]
        self.ids.update(zip(words, self.bpe.merge_many(words), strict=True))

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Of each text the ids."""
        bpe = self.bpe
        parts = [[(special, bpe.words(bpe.normalise(part)) if special < 0 else []) for part, special in bpe.segments(t)] for t in texts]
        if len(self.ids) > MEMO_WORDS:
            self.ids.clear()
        fresh = list(set().union(*(words for text in parts for _, words in text)).difference(self.ids))
        self.learn(fresh)
        ids, out = self.ids.__getitem__, []
        for text in parts:
            out.append(b"".join([b"".join(map(ids, words)) if special < 0 else array("i", [special]).tobytes() for special, words in text]))
        for w in fresh:
            if len(w) > MEMO_WORD_CHARS:
                del self.ids[w]
        offsets = np.cumsum([0] + [len(x) // 4 for x in out], dtype=np.int64).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), np.int32)))


def decode_ids(bpe: WordBpe, ids: pa.ListArray) -> pa.Array:
    """The tokens of each list joined by one space, as the tokenizer without a decoder joins them; ids that the vocabulary lacks are left out."""
    flat = ids.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(bpe.tokens)))
    if not pc.all(known, min_count=0).as_py():
        at = np.cumsum(np.append(0, known.to_numpy(zero_copy_only=False)))
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        ids = pa.ListArray.from_arrays(pa.array(at[np.append(0, np.cumsum(lengths))].astype(np.int32)), flat.filter(known))
        flat = ids.flatten()
    said = pa.ListArray.from_arrays(ids.offsets if ids.offset == 0 and ids.null_count == 0 else pa.array(np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())).astype(np.int32)), bpe.tokens.take(flat))
    return pc.binary_join(said, " ")


@lru_cache(maxsize=1)
def encoder(path: str, lexicon: bytes | None) -> Encoder:
    """One encoder for all tasks of a worker process, so that what it has learned is kept."""
    return Encoder(path, lexicon)


def word_counts(documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word binary, n long`` over all words (of at most 64 characters) of all documents, summed per task before the shuffle."""
    only = documents.select(F.col(text).alias("text"))

    def run(batches):
        bpe, counts = tokenizer(path), Counter()

        def rows():
            ok = [(w.encode("utf-8", "surrogatepass"), n) for w, n in counts.items() if len(w) <= MEMO_WORD_CHARS]
            for i in range(0, len(ok), 20_000):
                words, ns = zip(*ok[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ns, pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for part, special in bpe.segments(t or ""):
                    if special < 0:
                        counts.update(bpe.words(bpe.normalise(part)))
                if len(counts) > MEMO_WORDS:
                    yield from rows()
                    counts.clear()
        yield from rows()

    return only.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, path: str, *, words: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """Compile the ``words`` most frequent words of the whole corpus (ties: by word) with their ids."""
    top = word_counts(documents, path, text=text).orderBy(F.desc("n"), "word").limit(words).select("word").toArrow()
    bpe = tokenizer(path)
    return compile_lexicon({w: bpe.merge(w.decode("utf-8", "surrogatepass")) for w in top.column("word").to_pylist()})


def encode(documents: DataFrame, path: str, *, lexicon: bytes | None = None, decoded: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids array<int>`` and, if asked, ``decoded string`` made from the ids.

    A null or empty text has no ids and decodes to the empty string; a text of
    any length, or a word of any length, is encoded whole; special tokens
    spelled in a text become their ids; repeated rows give repeated rows; an
    empty table gives an empty table; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(build_lexicon(documents, path, text=text) if lexicon is None else lexicon)

    def each(keys, texts):
        ids = encoder(path, shared.value).encode(texts)
        return (keys, ids, decode_ids(tokenizer(path), ids)) if decoded else (keys, ids)

    kind = documents.select(key).schema[0].dataType.simpleString()
    return map_texts(documents, each, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded, key=key, text=text)


def decode(encoded: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded``: the tokens of each row's ids joined by one space, as the tokenizer without a decoder joins them.

    Null or empty ids give the empty string; ids that the vocabulary lacks are skipped.
    """
    kind = encoded.select(key).schema[0].dataType.simpleString()
    only = encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), decode_ids(tokenizer(path), batch.column(1))], names=["doc_id", "decoded"])

    return only.mapInArrow(run, f"doc_id {kind}, decoded string")


def digest(coded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

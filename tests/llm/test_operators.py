"""The training-data operators against brute-force versions, and the defined results for odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from factloom.llm import bpe, decontaminate, language, preference, secrets, simhash, token_counts
from factloom.llm.graph import components
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, found string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def some_texts(n=60, seed=3):
    rnd = random.Random(seed)
    words = ["the", "of", "Straße", "día", "café's", "x²", "don't", "###", "AKIA0", "日本語", "été", "and,", "a" * 70, "token=abc123def"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60))) for _ in range(n)]
    return [*out, "", None, " \n\t ", "\x1cA\x1dB", "<|endoftext|> a<|startoftext|>", "b" * 5000, out[0], out[0]]


# -- token counts


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=12), st.sets(st.text("ab", min_size=1, max_size=4), max_size=8), st.sets(st.text("ab", min_size=1, max_size=4), max_size=8))
def test_longest_match_equals_brute_force(word, initial, inside):
    assert token_counts.LongestMatch(sorted(initial), sorted(inside)).count(word) == token_counts.brute_count(word, initial, inside)


def test_token_counts(spark):
    texts = some_texts()
    initial, inside = map(set, token_counts.read_pieces(PIECES))
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, texts), PIECES).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        found = [token_counts.brute_count(token_counts.MARK + w.decode(), initial, inside) for w in (t or "").encode().split()]
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["n_unknown"]) == (len(found), sum(1 if f is None else f for f in found), sum(f is None for f in found))
    assert token_counts.token_counts(frame(spark, texts).limit(0), PIECES).count() == 0


def test_words_behind_the_bare_mark(spark):
    """A word that no piece with the mark begins is the mark and pieces from inside words, as the library has them."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = ["\u00e7", "\u00f1", "\u00f1es", "\u00dfe", "the"]
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, words), PIECES).collect()}
    for i, w in enumerate(words):
        assert got[i]["n_unknown"] == 0 and got[i]["n_tokens"] >= 1
    assert got[0]["n_tokens"] == len(library.encode(words[0])) == 2


# -- encoding


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation(), library.no_padding()
    texts = some_texts()
    coded = bpe.encode(frame(spark, texts), WORD_BPE, decoded=True)
    got = {r["doc_id"]: r for r in bpe.digest(coded).collect()}
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded.select("doc_id", "ids"), WORD_BPE).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert again[i] == said
    assert bpe.encode(frame(spark, texts).limit(0), WORD_BPE).count() == 0


def test_code_points_newer_than_pythons_tables():
    """Letters, capitals and marks that only the library's tables know are encoded as it does."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation(), library.no_padding()
    encoder, rnd = bpe.Encoder(WORD_BPE, None), random.Random(7)
    odd = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and bpe.has_newer(chr(c))]
    few = [0x558, 0x88F, 0xC5C, 0x1C89, 0x1AC3, 0x1AC4, 0xA7CE, 0xA7DC, 0x10D50, 0x16EA0, 0x105C9, 0x113C5, 0x16121]
    texts = [f"a{chr(c)}b {chr(c)} x{chr(c)}1" for c in few + rnd.sample(odd, 300)]
    texts += ["e\u0301" + "".join(rnd.choice(["a", " ", "\u0323", "\u0301", "5", chr(rnd.choice(few))]) for _ in range(8)) for _ in range(300)]
    got = encoder.encode(texts).to_pylist()
    assert [list(x) for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_and_short_merges_agree():
    t = bpe.tokenizer(WORD_BPE)
    rnd = random.Random(1)
    for _ in range(200):
        raw = bytes(rnd.choice(b"abcenothi") for _ in range(rnd.randrange(1, 60)))
        parts = [t.inner[b] for b in raw[:-1]] + [t.last[raw[-1]]]
        want = t._merge_short(list(parts))
        assert t._merge_long(list(parts)) == want
        assert np.frombuffer(t.merge_many([raw.decode()])[0], np.int32).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=20), st.lists(st.binary(max_size=6), max_size=10))
def test_lexicon_holds_its_words_alone(entries, others):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    words = [*entries, *others]
    for w, n in zip(words, lexicon.numbers(words).tolist(), strict=True):
        assert (n >= 0) == (w in entries)
        if n >= 0:
            assert np.frombuffer(lexicon.ids_of(n), np.int32).tolist() == entries[w]


# -- near duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    label = {i: i for i in prints}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    rnd = random.Random(8)
    base = [" ".join(f"w{rnd.randrange(400)}" for _ in range(300)) for _ in range(12)]
    texts = list(base)
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), "", None, "one two", "One  Two"]
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in simhash.digest(simhash.near_duplicates(frame(spark, texts))).collect()}
    want = brute_components(prints)
    assert len(got) == len(texts)
    for i in prints:
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
        assert got[i]["component_id"] == want[i]
    kept = simhash.keep_one(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 10_000, 10_000_000, 10_000_000_000])
def test_allocated_thresholds_lose_no_pair(n):
    """The thresholds add up to tau - m + 1 with those left out, so any 4 differing bits fall within one."""
    rnd = random.Random(n)
    both = np.full((64, 64), n // 4) + np.diag([n // 4] * 64)
    parts = simhash.allocate(n, both)
    for _ in range(3000):
        bits = rnd.sample(range(64), 4)
        assert any(sum(b in p.bits for b in bits) <= p.threshold for p in parts)


def test_links_join_dense_groups_without_all_pairs(spark):
    rnd = random.Random(2)
    centre = rnd.getrandbits(64)
    near = {centre} | {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(400)}
    rows = [(simhash.signed(x), 5 if x == centre else 1) for x in near]
    prints = spark.createDataFrame(rows, "fp long, copies long")
    n, both = simhash.bit_counts(prints)
    assert n == len(near)
    links = simhash.links(prints, simhash.allocate(n, both)).distinct()
    assert links.count() < 8 * len(near)
    assert components(links).select("label").distinct().count() == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


# -- preferences


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "A"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "B"),
        (2, "chosen", 0, "user", "x"), (3, "chosen", 0, None, None), (3, "rejected", 0, "", ""), (None, "rejected", None, "user", "z"), (1, "other", 0, "user", "no"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference.digest(preference.format_preferences(df)).collect()}
    assert got[1]["n_prefix"] == 1 and got[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1]["chosen"] == "<|im_start|>assistant\nA<|im_end|>\n" and got[1]["chosen_mask"] == "22:0,12:1"
    assert got[2]["rejected"] == "" and got[2]["n_prefix"] == 0
    assert got[3]["n_prefix"] == 1 and got[3]["chosen"] == got[3]["rejected"] == ""
    assert got[None]["chosen"] == ""
    assert preference.format_preferences(df.limit(0)).count() == 0


# -- decontamination


def distance(item, text):
    """Fewest edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j - 1] + (a != b), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def test_occurrences_equal_brute_force():
    rnd = random.Random(2)
    alphabet = "abcdefgh é"
    items = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60, 160)))) for i in range(8)]
    searcher = decontaminate.Searcher(items)
    joined = lambda t: "".join(map(chr, decontaminate.normalise(t)[0]))
    for _ in range(40):
        i, text = rnd.choice(items)
        letters = list(text)
        for _ in range(rnd.randrange(0, 12)):
            j = rnd.randrange(len(letters))
            letters[j] = rnd.choice(["", "x", letters[j] + "y"])
        doc = "foo  bar\n" + "".join(letters).upper() + " tail " * rnd.randrange(3)
        found = {x[0]: x for x in searcher.find(doc)}
        for item in searcher.items:
            d = distance(joined(items[item.item_id][1]), joined(doc))
            assert (item.item_id in found) == (d <= item.edits)
            if d <= item.edits:
                assert found[item.item_id][3] == d


def test_contaminated_documents_go(spark):
    item = "The quick brown fox jumps over the lazy dog while forty clever readers look on in silence."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    texts = ["nothing here", f"a {item.upper()} b", f"a {item.replace('brown', 'bruwn')} b", None, "", "Short", "a short text", item]
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.occurrences(frame(spark, texts), bench).collect())
    assert got == [(1, 1, 0), (2, 1, 1), (5, 3, 0), (7, 1, 0)]
    kept = decontaminate.clean(frame(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 6] and kept.columns == ["doc_id", "text", "ids", "found"]
    assert decontaminate.occurrences(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.occurrences(frame(spark, texts).limit(0), bench).count() == 0


# -- language identification


def test_language_accuracy_and_rejection(spark):
    rnd = random.Random(6)
    said = {"en": "the of and thing with water over house light stone".split(), "de": "der und nicht haus über wasser licht stein groß".split(), "fr": "le les été maison eau pierre lumière avec où".split()}
    rows = []
    for i in range(400):
        lang = rnd.choice(sorted(said))
        rows.append((i, " ".join(rnd.choice(said[lang]) for _ in range(rnd.randrange(5, 40))), lang if rnd.random() < 0.9 else None))
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 ²³ ... !!", "fr"), (1003, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    truth = {i: lang for i, _, lang in rows if lang and i < 1000 and zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i]["lang_pred"] == lang for i, lang in truth.items()) >= 0.97 * len(truth)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = language.fit(language.training_rows(df))
    kept = {r["doc_id"] for r in language.keep_accepted(df, model).collect()}
    assert not kept & {1000, 1001, 1002} and len(kept) >= 400
    assert language.identify(df.filter("lang is null")).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(df.limit(0)).count() == 0


# -- secrets


def brute_spans(text):
    out = []
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    for k, (kind, pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)):
            if len(m[group]) >= least:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    rnd = random.Random(9)
    bits = ["PassWord = 'abcdef'", "api_key:XYZ12", "apikey=\"q-_.=+/1\"", "token", "=", "AKIA" + "A1B2" * 4, "AKIAshort", "deadbeef" * 3, "DEADBEEF" * 3, "ſecret=abcdefg", "ghp_" + "a1" * 18, "é", "\n", "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", "x"]) for _ in range(rnd.randrange(12))) for _ in range(150)] + [None, "", "token=abcdef" * 400]
    scanned = secrets.scan_secrets(frame(spark, texts))
    got = {r["doc_id"]: r for r in secrets.digest(scanned).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in got[i]["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")] == want
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(frame(spark, texts)).collect()}
    assert clean[150] is None and clean[151] == "" and not any(brute_spans(t or "") for t in clean.values() if t and "<secret>" not in t)


def test_trigram_queries():
    rules = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.BASE + secrets.MORE}
    assert rules["hex"] == ()
    assert rules["access"] == ((frozenset({"aki", "kia"}),),)
    assert any(frozenset({"tok", "oke", "ken"}) in clause for clause in rules["assign"])


def test_repeated_grams_are_counted_by_bands(monkeypatch):
    """Periodic items and texts give the same regions either way, in little time; occurrences don't overlap."""
    import time

    rnd = random.Random(4)
    periods = ["ab", "abcab", "x", "lorem ipsum "]
    items = [(i, p * (k // len(p) + 1)) for i, (p, k) in enumerate((p, k) for p in periods for k in (40, 300))] + [(20, "".join(rnd.choice("abcdefgh ") for _ in range(120)))]
    texts = ["".join(rnd.choice([p * 30, items[-1][1], "zq", " "]) for _ in range(12)) for p in periods for _ in range(6)]
    found = {}
    for most in (0, 10**12):
        monkeypatch.setattr(decontaminate, "MANY_PAIRS", most)
        searcher = decontaminate.Searcher(items)
        found[most] = [searcher.find(t) for t in texts]
    assert found[0] == found[10**12] and any(found[0])
    for hits in found[0]:
        for i in {h[0] for h in hits}:
            own = sorted(h[1:3] for h in hits if h[0] == i)
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    monkeypatch.undo()
    searcher = decontaminate.Searcher([(1, "ab" * 500), (2, "q" * 1000)])
    began = time.perf_counter()
    hits = searcher.find("ab" * 50_000 + "q" * 40_000)
    assert {h[0] for h in hits} == {1, 2} and len(hits) >= 130 and time.perf_counter() - began < 20

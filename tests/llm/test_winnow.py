"""Winnowing against a brute-force version."""

import hashlib
import random

import pytest
from factloom.llm import winnow


def brute_edited(rows):
    """The next row in descending key; the first after the last."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        out[i] = text[: len(text) - third] + after[:third]
    return out


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(4)
    words = [f"w{i}é" for i in range(60)]
    rows = [(i * 7, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for i in range(120)]
    rows += [(5000, ""), (5001, "  \t\n"), (5002, "one"), (5003, rows[3][1]), (5004, "a " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = winnow.digest(winnow.edited_fingerprints(df)).collect()
    return dict(rows), {r["doc_id"]: r for r in got}, len(got)


def test_edited_texts(found):
    rows, got, n = found
    assert n == len(rows)
    want = brute_edited(list(rows.items()))
    for i, text in want.items():
        assert got[i]["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[i]["n_chars"] == len(rows[i])


def test_equal_texts_and_bounds(found):
    rows, got, _ = found
    assert got[5003]["fingerprint"] == got[21]["fingerprint"]
    assert got[5000]["fingerprint"] == got[5001]["fingerprint"] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


def test_windows(spark):
    """Each window's least hash is kept, the rightmost on ties, and nothing else."""
    rnd = random.Random(1)
    text = " ".join(rnd.choice("abc") for _ in range(300))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(x["hash"], x["position"]) for x in winnow.fingerprint_documents(df).first()["fingerprint"]]
    words = text.split()
    grams = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    of = {}
    for h, p in got:
        assert of.setdefault(grams[p], h) == h
    chosen = dict((p, h) for h, p in got)
    for i in range(len(grams) - 7):
        inside = [(h, -p) for p, h in chosen.items() if i <= p < i + 8]
        assert inside
        least = min(inside)
        assert all(of.get(grams[p], least[0] + 1) >= least[0] for p in range(i, i + 8))
        assert not any(of.get(grams[p]) == least[0] and p > -least[1] for p in range(i, i + 8))


def pieces(word):
    """The cut of a long word, spelled out."""
    out, at = [], 0
    for i, c in enumerate(word, 1):
        if c in "aeiouAEIOU0123456789" or ord(c) > 127 or i - at == 32:
            out.append(word[at:i])
            at = i
    return out + [word[at:]] * (at < len(word))


def test_long_words_are_cut_by_content(spark):
    rnd = random.Random(6)
    words = ["short", "x" * 32, "x" * 100, "".join(rnd.choice("bcdfghae0é") for _ in range(300)), "日本語の文" * 40, "e" * 33]
    df = spark.createDataFrame([(1, " ".join(words) + "\n"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["w"] for r in df.select("doc_id", winnow.words_of(df["text"]).alias("w")).collect()}
    assert got[1] == [p for w in words for p in ([w] if len(w) <= 32 else pieces(w))]
    assert not got[2] and not got[3]


def test_texts_without_blanks_stay_alike(spark):
    """Two thirds of an unspaced text are unchanged, and its fingerprint says so."""
    rnd = random.Random(8)
    for among in ("".join(chr(0x4E00 + i) for i in range(900)), "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/"):
        rows = [(i, "".join(rnd.choice(among) for _ in range(3000))) for i in range(4)]
        got = winnow.digest(winnow.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
        assert all(0.35 < r["near_edited"] < 0.65 and r["near_next"] < 0.1 for r in got)


def test_likeness_and_hashes_are_those_of_the_fingerprints(found):
    """near_edited and near_next follow from the printed fingerprints; every hash is that of its gram's words alone."""
    rows, got, _ = found
    of = lambda text: {x.split("@")[0] for x in text.split(",") if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order = sorted(rows, reverse=True)
    want, grams = brute_edited(list(rows.items())), {}
    for k, i in enumerate(order):
        mine, edited, after = of(got[i]["fingerprint"]), of(got[i]["edited_fingerprint"]), of(got[order[(k + 1) % len(order)]]["fingerprint"])
        assert got[i]["near_edited"] == pytest.approx(like(mine, edited)) and got[i]["near_next"] == pytest.approx(like(mine, after))
        for text, prints in ((rows[i], got[i]["fingerprint"]), (want[i], got[i]["edited_fingerprint"])):
            words = text.split()
            for x in filter(None, prints.split(",")):
                h, at = x.split("@")
                gram = tuple(words[int(at, 16) : int(at, 16) + 4])
                assert grams.setdefault(gram, h) == h
    assert len(set(grams.values())) == len(grams) > 300


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "a b c d e f g h i j k l", "y"), (None, "z z", "q"), (1, None, "x")], "doc_id long, text string, prints string")
    assert winnow.edited_fingerprints(df).count() == 4
    assert winnow.digest(winnow.edited_fingerprints(df.limit(0))).count() == 0

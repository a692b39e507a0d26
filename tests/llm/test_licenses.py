"""Licence scans against brute force over all regions of short texts."""

import random

import pytest
from factloom.llm import licenses

FILLER = [f"word{i}" for i in range(300)]


def brute_regions(text, template, least=licenses.LEAST):
    """The likeliest region, then the likeliest without a word of it, and so on (ties: the longest, the first)."""
    ws, grams = licenses.words(text), licenses.bigrams(licenses.words(template))
    every = []
    for i in range(len(ws)):
        for j in range(i + 2, len(ws) + 1):
            d = licenses.dice(licenses.bigrams(ws[i:j]), grams)
            if d >= least:
                every.append((-d, i - j, i, j))
    out = []
    for d, _, i, j in sorted(every):
        if all(j <= a or i >= b for _, a, b in out):
            out.append((-d, i, j))
    return sorted(out, key=lambda x: x[1])


def edited(rnd, words, rate, how):
    out = []
    for w in words:
        x = rnd.random()
        if x < rate and how == "inserted":
            out += [w, rnd.choice(FILLER)]
        elif x < rate and how == "dropped":
            continue
        elif x < rate and how == "replaced":
            out.append(rnd.choice(FILLER))
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("how", ["inserted", "dropped", "replaced", "cut"])
def test_regions_equal_brute_force(how):
    rnd = random.Random(how)
    short = [(n, t) for n, t in licenses.TEMPLATES if len(licenses.words(t)) <= 40]
    for _ in range(25):
        name, template = rnd.choice(short)
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            ws = licenses.words(template)
            ws = ws[: max(2, int(len(ws) * rnd.uniform(0.6, 1)))] if how == "cut" else edited(rnd, ws, rnd.uniform(0, 0.3), how)
            parts += rnd.choices(FILLER, k=rnd.randrange(0, 6)) + ws
        text = "".join(w + rnd.choice([" ", "\n", ", "]) for w in parts)
        want = brute_regions(text, template)
        got = licenses.Matcher(((name, template),)).scan(text)
        assert [round(x[1], 12) for x in got] == [round(d, 12) for d, _, _ in want]
        assert [licenses.words(text[a:b]) for _, _, a, b in got] == [licenses.words(text)[i:j] for _, i, j in want]


def test_recall_of_edited_notices():
    """Notices over several lines, shortened, stretched or changed: found whenever the whole has the coefficient."""
    rnd, asked, found = random.Random(8), 0, 0
    matcher = licenses.Matcher()
    for name, template in licenses.TEMPLATES:
        for how in ("inserted", "dropped", "replaced"):
            for _ in range(6):
                ws = edited(rnd, licenses.words(template), rnd.uniform(0.02, 0.25), how)
                if licenses.dice(licenses.bigrams(ws), licenses.bigrams(licenses.words(template))) < licenses.LEAST:
                    continue
                cut = rnd.randrange(len(ws) + 1)
                text = " ".join(rnd.choices(FILLER, k=10)) + "\n" + " ".join(ws[:cut]) + "\n  * " + " ".join(ws[cut:]) + "\n" + " ".join(rnd.choices(FILLER, k=10))
                asked += 1
                got = matcher.scan(text)
                found += any(x[1] >= licenses.LEAST for x in got)
                assert all(got[k][3] <= got[k + 1][2] for k in range(len(got) - 1))
    assert asked > 150 and found == asked


def test_adjacent_notices_are_all_found():
    notice = dict(licenses.TEMPLATES)["GPL-3.0-or-later"]
    changed = " ".join(w if i % 12 else "changed" for i, w in enumerate(notice.split()))
    got = licenses.Matcher().scan(f"{changed}\n{notice} {notice}")
    assert [x[0] for x in got] == ["GPL-3.0-or-later"] * 3 and got[1][1] == got[2][1] == 1.0 > got[0][1]


def test_many_copies_take_linear_work():
    notice = dict(licenses.TEMPLATES)["MPL-2.0"]
    assert len(licenses.Matcher().scan((notice + "\n") * 2000)) == 2000


def test_licenses(spark):
    notice = dict(licenses.TEMPLATES)["GPL-3.0"]
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    texts = ["plain words of the text", f"before\n{notice}\nafter", "x " + mit.replace(", ", ",\n* ") + " y", None, "", notice.upper(), "\u0130\u0130 " + notice]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "y")], "doc_id long, text string, licenses string")
    rows = licenses.scan_licenses(df).collect()
    got = {r["doc_id"]: r["licenses"] for r in rows}
    assert len(rows) == len(texts) + 1 and [len(got[i]) for i in range(7)] == [0, 1, 1, 0, 0, 1, 1]
    for i in (1, 6):
        assert texts[i][got[i][0]["start"] : got[i][0]["end"]] == notice.rstrip(".")
    assert got[2][0]["license"] == "MIT" and got[2][0]["dice"] == 1.0
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_templates_from_a_folder(tmp_path):
    (tmp_path / "Own-1.0").write_text("This is a licence of our own and it says rather little about anything at all.")
    more = licenses.templates_from(str(tmp_path))
    assert licenses.Matcher(licenses.TEMPLATES + more).scan("So: this is a licence of our own, and it says rather little about anything at all!")[0][0] == "Own-1.0"

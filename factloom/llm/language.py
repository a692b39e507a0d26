"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its words' character n-grams, each
hashed to a bucket; a linear layer gives the class scores.  Training is
stochastic gradient descent in numpy over a bounded sample of labelled rows.
A temperature and a rejection threshold are calibrated on rows of that sample
that training did not see.  A softmax is sure of texts in no learned language,
too, so a text must also be familiar: its n-grams must be about as likely under
the chosen language as those of calibration rows, by a bound set against rows
whose language is left out and words of shuffled letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORDS, col, keep_texts, map_texts

#: At most this many distinct labelled rows are fitted, those with the smallest hash of key and text: the one bound of this operator.
TRAIN_ROWS = 3_000
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
DIM = 16
EPOCHS = 6
RATE = 0.25
SIZES = (1, 2, 3, 4)
SEED = 17
#: Share of known-good calibration rows that the threshold may refuse.
REFUSED = 0.0005
#: Share of an n-gram that a language's rows don't have.
UNSEEN = 1 / (16 * BUCKETS)
#: Share of the negatives that the bound of familiarity must turn away where it is set between them and good rows.
TURNED_AWAY = 0.99
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Maximal runs of letters in lower case: digits, punctuation and marks carry no language."""
    words = _LETTERS.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the bucket of the n-gram at every place of the words between marks, and the places where none fits."""
    marked = "<" + "><".join(words) + ">"
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # to the end of the word
    rolled = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            rolled[: len(codes) - n + 1] = (rolled[: len(codes) - n + 1] + codes[n - 1 :]) * _ODD
            if n in SIZES:
                yield ((rolled ^ np.uint64(n)) * _ODD >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), left < n


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares."""
    words = letter_words(text)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(words), 50_000):
        for buckets, bad in grams(words[start : start + 50_000]):
            counts += np.bincount(buckets[~bad], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # BUCKETS x classes: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float
    #: BUCKETS x classes: the logarithm of an n-gram's share; for each class its mean over a text, variance between texts and by n-gram.
    known: np.ndarray | None = None
    usual: np.ndarray | None = None
    least_familiar: float = -np.inf

    def familiarity(self, mean: np.ndarray, n: float, best: int) -> float:
        """How many deviations a text of n n-grams is from the usual mean logarithm of its language; below 0: less known."""
        centre, between, each = self.usual[best]
        return float((mean[best] - centre) / np.sqrt(between + each / n))

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """Train on four fifths of the rows, calibrate on the rest; None without a labelled row that has letters."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    classes = sorted({r[0] for r in rows})
    number = {c: i for i, c in enumerate(classes)}
    kept = rows if len(rows) < 50 else [r for i, r in enumerate(rows) if i % 5]
    held = rows if len(rows) < 50 else rows[::5]
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    share = np.bincount([number[r[0]] for r in kept], minlength=len(classes))
    weight = (len(kept) / (len(classes) * np.maximum(share, 1))).clip(0.2, 5)
    steps, done = EPOCHS * len(kept), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(kept)):
            lang, ids, x = kept[i]
            y = number[lang]
            rate = RATE * (1 - done / steps) * weight[y]
            done += 1
            rows_of = emb[ids]
            hidden = x @ rows_of
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
            emb[ids] = rows_of - np.outer(x * (rate / (x @ x)), grad)
    model = Model(classes, (emb @ out).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    logits = np.array([x @ model.table[ids] for _, ids, x in held])
    target = np.array([number.get(r[0], -1) for r in held])

    def loss(t: float) -> float:
        model.temperature = t
        p = model.probabilities(logits)
        return float(-np.log(np.maximum(p[np.arange(len(p)), target], 1e-12)).mean())

    model.temperature = min((2.0 ** (k / 2) for k in range(-4, 9)), key=loss)
    p = model.probabilities(logits)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == target])
    if len(right):
        model.threshold = float(right[int(REFUSED * len(right))] * 0.9)
    calibrate_familiarity(model, kept, held, logits, target)
    return model


def calibrate_familiarity(model: Model, kept: list, held: list, logits: np.ndarray, target: np.ndarray) -> None:
    """Fit the shares of n-grams by language on ``kept`` and the bound on ``held``, against negatives."""
    k = len(model.classes)
    number = {c: i for i, c in enumerate(model.classes)}
    share, rows = np.zeros((BUCKETS, k)), np.zeros(k)
    for lang, ids, x in kept:
        share[ids, number[lang]] += x
        rows[number[lang]] += 1
    model.known = np.log(share / np.maximum(rows, 1) + UNSEEN)
    own = kept is held  # too few rows to hold any back: each is scored by the others
    means, sizes = np.zeros((len(held), k)), np.zeros(len(held))
    for i, (_, ids, x) in enumerate(held):
        table = model.known[ids].copy()
        if own and rows[target[i]] > 1:
            c = target[i]
            table[:, c] = np.log(np.maximum(share[ids, c] - x, 0) / (rows[c] - 1) + UNSEEN)
        means[i], sizes[i] = x @ table, max(1, round(1 / float(x.min())))
    best = logits + model.bias
    model.usual = np.zeros((k, 3))
    for c in range(k):
        at = np.flatnonzero(target == c)
        if not len(at):
            model.usual[c] = (0.0, np.inf, 0.0)
            continue
        weight = sizes[at] / (sizes[at] + 100)
        centre = float(np.average(means[at, c], weights=weight))
        off = (means[at, c] - centre) ** 2
        design = np.column_stack([np.ones(len(at)), 1 / sizes[at]])
        between, each = (max(0.0, float(v)) for v in np.linalg.lstsq(design * weight[:, None], off * weight, rcond=None)[0])
        model.usual[c] = centre, max(between, 1e-3), max(each, 1.0)
    good = np.sort([model.familiarity(means[i], sizes[i], t) for i, t in enumerate(target) if best[i].argmax() == t])
    if not len(good):
        return
    bad = []
    for i, t in enumerate(target):  # as if its language had not been learned
        if k > 1:
            others = best[i].copy()
            others[t] = -np.inf
            bad.append(model.familiarity(means[i], sizes[i], int(others.argmax())))
    rng = np.random.default_rng(SEED)
    for c in range(k):
        letters = np.array([share[next(grams([a]))[0][1], c] for a in _ALPHABET]) + 1e-9
        for _ in range(100):
            words = ["".join(rng.choice(list(_ALPHABET), size=n, p=letters / letters.sum())) for n in rng.integers(3, 10, 40)]
            ids, x = features(" ".join(words))
            n = sum(int((~missing).sum()) for _, missing in grams(words))
            bad.append(model.familiarity(x @ model.known[ids], n, int((x @ model.table[ids] + model.bias).argmax())))
    low, high = float(good[int(REFUSED * len(good))]), float(np.quantile(bad, TURNED_AWAY))
    # halfway to the negatives where they are apart; where they overlap, good rows stay
    model.least_familiar = (low + high) / 2 if high < low else low


def training_rows(documents: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = TRAIN_ROWS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of the bounded sample: ``rows`` distinct rows (by key, text and label) with the least hash, no more, however many share a key.

    Texts stay on the executors; each row sends ``BUCKETS`` entries at most.
    """
    labelled = documents.filter(col(label).isNotNull() & col(text).isNotNull())
    order = F.xxhash64(F.coalesce(col(key).cast("string"), F.lit("")), col(text))
    hashed = labelled.select(order.alias("h"), col(label).cast("string").alias("lang"), col(text).alias("_t"))

    def least(batches):
        """A task's first distinct rows: no more than ``rows`` leave it."""
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = (now if held is None else pa.concat_tables([held, now])).group_by(["h", "lang"]).aggregate([]).sort_by([("h", "ascending"), ("lang", "ascending")]).slice(0, rows)
        if held is not None:
            yield from held.to_batches()

    edge = hashed.select("h", "lang").mapInArrow(least, "h long, lang string").distinct().orderBy("h", "lang").limit(rows).agg(F.max(F.struct("h", "lang"))).first()[0]
    if edge is None:
        return []
    # repeated rows are put together before their features are made; no more than ``rows`` are left
    first = (F.col("h") < edge["h"]) | ((F.col("h") == edge["h"]) & (F.col("lang") <= edge["lang"]))
    sample = hashed.filter(first).groupBy("h", "lang").agg(F.first("_t").alias("_t"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                made = [features(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))],
                    names=["h", "lang", "ids", "share"],
                )

    got = sample.mapInArrow(run, "h long, lang string, ids array<int>, share array<float>").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    return [(lang, np.array(i, np.int32), np.array(s, np.float32)) for lang, i, s in zip(got.column("lang").to_pylist(), (x.values.to_numpy() for x in got.column("ids")), (x.values.to_numpy() for x in got.column("share")), strict=True)]


class Predictor:
    """Predicts lists of texts; each new word's n-grams are summed once."""

    def __init__(self, model: Model | None):
        self.model = model
        self.place: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.column_stack([model.table, model.known, np.ones(len(model.table))]) if model else None

    def learn(self, words: list[str]) -> None:
        """Append a row for each new word: the sum over its n-grams of the table's rows, and their number."""
        starts = np.cumsum([0] + [len(w) + 2 for w in words[:-1]])
        total = np.zeros((starts[-1] + len(words[-1]) + 2, self.table.shape[1]))
        for buckets, bad in grams(words):
            part = self.table[buckets]
            part[bad] = 0
            total += part
        rows = np.add.reduceat(total, starts, axis=0)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.rows[:] = [np.concatenate([*self.rows, rows])]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        model, place = self.model, self.place
        if len(place) > MEMO_WORDS:
            place.clear(), self.rows.clear()
        all_words = [letter_words(t) if model else [] for t in texts]
        new = [w for w in dict.fromkeys(w for words in all_words for w in words) if w not in place]
        for start in range(0, len(new), 20_000):
            self.learn(new[start : start + 20_000])
        langs, scores, accepted = [], [], []
        for words in all_words:
            if not words:
                langs.append("und"), scores.append(0.0), accepted.append(False)
                continue
            total = np.zeros(self.table.shape[1])
            for start in range(0, len(words), 100_000):
                total += self.rows[0][[place[w] for w in words[start : start + 100_000]]].sum(axis=0)
            mean, k = total[:-1] / total[-1], len(model.classes)
            p = model.probabilities(mean[:k])
            best = int(p.argmax())
            sure = p[best] >= model.threshold and model.familiarity(mean[k:], total[-1], best) >= model.least_familiar
            langs.append(model.classes[best]), scores.append(float(p[best])), accepted.append(bool(sure))
        return langs, scores, accepted


def predict(documents: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for every whole text.

    ``und`` with score 0 and not accepted if the text is null or empty, has no
    letter, or nothing was learned.  Otherwise the likeliest learned language
    (ties: the first in order) and its calibrated probability; ``accepted`` is
    false below the calibrated threshold or the bound of familiarity.  Repeated rows give repeated rows; an
    empty table gives an empty table; other columns aren't read.
    """
    held: list[Predictor] = []

    def each(keys, texts):
        if not held:
            held.append(Predictor(model))
        return (keys, *held[0].predict(texts))

    kind = documents.select(key).schema[0].dataType.simpleString()
    return map_texts(documents, each, f"doc_id {kind}, lang_pred string, score double, accepted boolean", key=key, text=text)


def keep_accepted(documents: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """The documents whose language is recognised, with all their columns; the others go, null and letterless texts among them."""
    held: list[Predictor] = []

    def accept(texts: list[str]) -> list[bool]:
        if not held:
            held.append(Predictor(model))
        return held[0].predict(texts)[2]

    return keep_texts(documents, accept, text=text)


def held_out(key: str = "doc_id"):
    """True for the third of the keys that training must not see (a null key counts as its empty text)."""
    return F.crc32(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(documents: DataFrame, *, training: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Fit on the labelled ``training`` rows (default: those not held out) and predict for every document."""
    among = documents.filter(~held_out(key)) if training is None else training
    return predict(documents, fit(training_rows(among, key=key, text=text, label=label)), key=key, text=text)

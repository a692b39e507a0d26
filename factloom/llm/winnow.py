"""Winnowing fingerprints of whole texts, in DataFrame functions alone.

The grams are k = 4 consecutive words.  A word of more than 32 code points, as in
scripts without blanks or in encoded data, is cut where its content says: after
each ASCII vowel or digit and each code point beyond ASCII, and 32 code points
after the last cut.  A gram's hash is the cyclic polynomial of
the word hashes (the rolling hash of the gram), built by doubling so that
every step is one pass over an array; it is mixed once more so that small
values are spread evenly.  In each window of w = 8 grams the least hash is
kept, the rightmost on ties, with its position: any run of w + k - 1 = 11
words that two texts share gives them a common fingerprint.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_parts

#: Both are powers of two, so that doubling reaches them.
GRAM_WORDS = 4
WINDOW_GRAMS = 8
LONG_WORD = 32
_CUT = r"(?<=[aeiouAEIOU0-9]|[^\x00-\x7F])|(?<=\G.{32})"
_BLANK = " \t\n\x0b\f\r"
#: Of a packed number the low bits that hold how far from a window's end its least gram lies.
_LOW, _LOW_BITS = 7, 3


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _joined(step: int):
    """The hash of ``step`` words and that of the ``step`` words after them make one."""
    return lambda x, i: _turned(x, step).bitwiseXOR(F.coalesce(F.get("_h", i + step), F.lit(0).cast("long")))


def _lesser(step: int):
    """The lesser of a window and the one ``step`` grams on; on ties the later, whose low bits are less."""
    return lambda x, i: F.least(x, F.get("_h", i + step) - step)


def _split(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _cut(words: Column) -> Column:
    pieces = lambda w: F.when(F.length(w) <= LONG_WORD, F.array(w)).otherwise(F.filter(F.split(w, _CUT), lambda x: x != ""))
    # bytes are counted without reading a word, so texts without a long one cost next to nothing
    return F.when(F.exists(words, lambda w: F.octet_length(w) > LONG_WORD), F.flatten(F.transform(words, pieces))).otherwise(words)


def words_of(text: Column) -> Column:
    """The words of a text, long ones cut."""
    return _cut(_split(text))


def with_prints(df: DataFrame, text: str, out: str) -> DataFrame:
    """Append ``out``: the chosen grams of ``text`` as an array of (hash of 60 bits, position of the first word from 0).

    A number holds a gram's hash above three bits that say how far from the
    window's end it lies, so the least number of a window is the rightmost of
    its least hashes.  A text of fewer than k words is one gram, one of fewer
    than w grams one window; a text without words, or null, has none.
    """
    df = df.withColumn("_h", _split(F.col(text)))
    df = df.withColumn("_h", F.transform(_cut(F.col("_h")), lambda w: F.xxhash64(w)))
    df = df.withColumn("_n", F.size("_h"))
    step = 1
    while step < GRAM_WORDS:
        df = df.withColumn("_h", F.transform("_h", _joined(step)))
        step *= 2
    grams = F.slice("_h", F.lit(1), F.greatest(F.lit(1), F.col("_n") - (GRAM_WORDS - 1)))
    df = df.withColumn("_h", F.transform(grams, lambda x: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x), _LOW_BITS + 1), _LOW_BITS).bitwiseOR(F.lit(_LOW).cast("long"))))
    df = df.withColumn("_n", F.size("_h"))
    step = 1
    while step < WINDOW_GRAMS:
        df = df.withColumn("_h", F.transform("_h", _lesser(step)))
        step *= 2
    low = lambda v: v.bitwiseAND(F.lit(_LOW).cast("long")).cast("int")
    # a window chooses the gram of the window before it if its low bits are one more
    chosen = lambda v, i: F.when((i == 0) | (low(v) - low(F.get("_h", i - 1)) != 1), F.struct(F.shiftrightunsigned(v, _LOW_BITS).alias("hash"), (i + _LOW - low(v)).alias("position")))
    df = df.withColumn("_h", F.slice("_h", F.lit(1), F.greatest(F.lit(1), F.col("_n") - (WINDOW_GRAMS - 1))))
    return df.withColumn(out, F.filter(F.transform("_h", chosen), lambda s: s.isNotNull())).drop("_h", "_n")


def hashes(prints: Column | str) -> Column:
    """The distinct hashes of a fingerprint, positions dropped."""
    return F.array_distinct(F.transform(prints, lambda s: s["hash"]))


def printed(prints: Column | str) -> Column:
    """``hash@position`` in hexadecimal, comma-joined in the order of the text."""
    return F.array_join(F.transform(prints, lambda s: F.concat(F.lower(F.hex(s["hash"])), F.lit("@"), F.lower(F.hex(s["position"])))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of distinct hashes; two empty ones are alike (1), an empty and another not (0)."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def fingerprint_documents(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint array<struct<hash,position>>`` of every row's whole text.

    Null, empty and blank texts have an empty fingerprint; repeated rows are
    repeated; an empty table gives an empty table; other columns aren't read.
    """
    return with_prints(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), "_text", "_p").select("doc_id", F.col("_p").alias("fingerprint"))


def _numbers(values: list[int | None]) -> Column:
    """Whole numbers as one constant of the plan, however many."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def range_of(key: str, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below a key, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    held = _numbers(cuts)
    return F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) < F.col(key), low + step).otherwise(low))


def edited_fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text's fingerprint beside that of its edited text and of the next document.

    The edited text has its last third of code points replaced by as many
    first code points (or all) of the next document in descending key, the
    first after the last.  Keys are whole numbers; rows of one key follow each
    other by the hash of their text; null keys come after all others; null
    texts are empty.  One row comes out for each row that goes in.

    The keys are cut into ranges at quantiles of all of them.  The texts are
    shuffled once, by range, with a copy of the row that heads the range after; each
    range is then put in order by itself, and the driver only holds one key of each.
    """
    spark = documents.sparkSession
    lowest = -(2**63)
    parts = shuffle_parts(spark)
    rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = 4 * parts
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit([i / ranges for i in range(1, ranges)]), 10 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    placed = rows.withColumn("part", range_of("doc_id", cuts))
    heads = {r["part"]: r["head"] for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    own = F.struct(F.col("part"), F.lit(False).alias("last"))
    places = F.array(own)
    if order:
        before = {r: order[k - 1] for k, r in enumerate(order)}  # the head of each range also follows the range above
        head, above = (F.get(_numbers([of.get(r) for r in range(len(cuts) + 1)]), F.col("part")) for of in (heads, before))
        places = F.when(head == F.col("doc_id"), F.array(own, F.struct(above.cast("int").alias("part"), F.lit(True).alias("last")))).otherwise(places)
    placed = placed.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.part", "at.last")
    dealt = placed.repartition(parts, "part").withColumn("text_hash", F.xxhash64("text"))
    dealt = with_prints(dealt, "text", "prints").withColumn("hashes", hashes("prints"))
    within = Window.partitionBy("part").orderBy("last", F.desc("doc_id"), "text_hash")
    follow = F.lead(F.struct("text", "hashes")).over(within)
    third = F.floor(F.length("text") / 3).cast("int")
    both = dealt.withColumn("next", follow).filter(~F.col("last")).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next.text", F.lit(1), third)))
    both = both.withColumn("next_hashes", F.col("next.hashes")).drop("text", "next")
    both = with_prints(both, "edited", "edited_prints")
    return both.select(F.when(F.col("doc_id") != lowest, F.col("doc_id")).alias("doc_id"), "n_chars", "text_hash", "edited", "prints", "hashes", "edited_prints", "next_hashes")


def digest(found: DataFrame) -> DataFrame:
    sets = found.withColumn("_edited", hashes("edited_prints"))
    return sets.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed("prints").alias("fingerprint"),
        printed("edited_prints").alias("edited_fingerprint"),
        likeness("hashes", "_edited").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
        F.lower(F.hex("text_hash")).alias("text_hash"),
    )

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word memos are emptied when they reach this many entries, so a worker's memory is bounded.
MEMO_WORDS = 200_000
#: Longer words are never kept in a memo.
MEMO_WORD_CHARS = 64
#: Documents handled at once by the array-based operators, in characters.
BLOCK_CHARS = 2_000_000
_HASHED_BYTES = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_BYTES = np.random.default_rng(5).integers(1, 2**63, 256).astype(np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own only where none is set."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared checkpoint folder.

    The size that the planner guessed for what made it isn't handed on: in a loop
    of joins that guess is a product that grows to thousands of digits.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    held = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def give_back() -> None:
    """Return what Arrow keeps of freed batches: workers outlive their tasks, and a batch of texts is large."""
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, each: Callable, schema: str, *, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``each(keys, texts, *more)`` gives the columns of ``schema`` for lists of keys and texts (a null text is empty).

    Only the named columns leave the JVM, so extra columns of the input never clash.
    """
    names = [f"_{i}" for i in range(2 + len(more))]
    only = df.select(*(F.col(_quoted(c)).alias(n) for c, n in zip((key, text, *more), names, strict=True)))
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                keys, texts = part.column(0), [x or "" for x in part.column(1).to_pylist()]
                got = each(keys, texts, *(part.column(2 + i) for i in range(len(more))))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(got, arrow, strict=True)], schema=arrow)
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return only.mapInArrow(run, schema)


def keep_texts(df: DataFrame, wanted: Callable, *, text: str = "text") -> DataFrame:
    """The rows for whose texts (null: empty) ``wanted`` gives True, with all columns."""
    place = df.schema.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, place):
                yield part.filter(pa.array(wanted([x or "" for x in part.column(place).to_pylist()]), pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)


def blocks(batch: pa.RecordBatch, column: int = 1, most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(29)) * _ODD
        return x ^ x >> np.uint64(32)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (maximal runs free of ASCII white space, A-Z lower-cased) and the number of words of each text."""
    counts, parts, held, size = np.zeros(len(texts), np.int64), [], [], 0
    for i, t in enumerate(texts):
        ws = t.encode("utf-8", "surrogatepass").lower().split()
        counts[i] = len(ws)
        if ws:
            held.append(b" ".join(ws) + b" ")
            size += len(held[-1])
        if size > _HASHED_BYTES or i == len(texts) - 1:  # the arrays below are wide, so few bytes at a time
            parts.append(_hashes(np.frombuffer(b"".join(held), np.uint8)))
            held, size = [], 0
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def _hashes(data: np.ndarray) -> np.ndarray:
    """Of each word that ends with a blank."""
    ends = np.flatnonzero(data == 0x20)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.append(0, ends[:-1] + 1)
    lengths = ends - starts + 1
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(powers)
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        return mixed(np.add.reduceat(_BYTES[data] * powers[place], starts))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(_quoted(name))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

"""Helpers that several operators share: staged tables, word hashes, table readers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from threadloom.plans.staging import settle

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage; lost executors lose none of it."""
    return settle(df, name)


#: Rows of whole texts and bytes that go to a Python worker at once, where the session leaves Spark's defaults of 10,000 and 64 MB.
TEXTS_A_BATCH, BYTES_A_BATCH = 1000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with the session set to send fewer texts at once; a worker's memory is then that of a batch and of its own tables."""
    conf = df.sparkSession.conf
    for name, usual, own in (("maxRecordsPerBatch", "10000", TEXTS_A_BATCH), ("maxBytesPerBatch", "67108864b", BYTES_A_BATCH)):
        if conf.get(f"spark.sql.execution.arrow.{name}", usual) == usual:
            conf.set(f"spark.sql.execution.arrow.{name}", str(own))
    return df


_kept: dict[Hashable, object] = {}  # in a Python worker


def kept[T](key: Hashable, make: Callable[[], T]) -> T:
    """What make gives, made once a Python worker for as long as its tasks keep this key."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def let_go(keep: Hashable = None) -> None:
    """A worker outlives operators: what it keeps for others than this one goes."""
    gone = [x for x in _kept if x != keep]
    for key in gone:
        del _kept[key]
    if gone:
        gc.collect()  # what is kept may lead back to itself


def give_back() -> None:
    """What is free goes back to the system, for the executor's JVM and the other workers."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy[A, B](run: Callable[[Iterator[A]], Iterator[B]], keep: Hashable = None) -> Callable[[Iterator[A]], Iterator[B]]:
    """run, a task of a Python worker, that leaves the worker no more than what is kept for keep."""

    @wraps(run)
    def tidied(batches: Iterator[A]) -> Iterator[B]:
        let_go(keep)
        yield from run(batches)
        give_back()

    return tidied


def words_of(text: str | None) -> list[str]:
    """The words of WORD, in order. str.split() without an argument would also split at other Unicode spaces."""
    return [w for w in text.translate(_SPACES).split(" ") if w] if text else []


class WordHashes:
    """64-bit hashes of words, with a memory of bounded size."""

    def __init__(self, limit: int = 100_000) -> None:
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.limit:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes of every run of width words: the base-weighted sum of the word hashes mod 2**64, then mixed.

    Widths are built by doubling (a run of 2n words from two of n), so a width costs its logarithm in array steps.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    part, part_width, done = h.copy(), 1, 0
    acc: np.ndarray | None = None
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if acc is None:
                    acc = part
                else:  # acc covers the first done words; part follows
                    m = min(len(acc), len(part) - done)
                    acc = acc[:m] * np.uint64(pow(base, part_width, 1 << 64)) + part[done : done + m]
                done += part_width
            left >>= 1
            if left:
                m = len(part) - part_width
                part = part[:m] * np.uint64(pow(base, part_width, 1 << 64)) + part[part_width : part_width + m]
                part_width *= 2
        return mix64(acc[:n])

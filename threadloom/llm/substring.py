"""Substring dedup (operator 9): words in windows of fixed length that also start in a document with a smaller id go.

Each window of width words has a Rabin-Karp hash. To count windows without shuffling all of them, each stands under the
least hash of its runs of gram words: equal windows have equal ones, neighbours mostly share theirs. Spark finds the
runs that occur in more than one document, and only windows under these are dealt out by their own hash (96 bits), where
each learns the smallest id it starts in. What is repeated merges into maximal intervals, and their words are removed.

Texts reach Python as Arrow batches and are worked on as arrays of bytes, of word hashes and of windows, for many texts at
once; only what is left of a text is put together word by word.

A task that meets a window again in a document with a greater id marks it at once, and a document hands on a window once
however often it has it. Beyond a bound the task remembers those that it met most often. So a window in a third of all documents is shuffled about once a task (a partial minimum before
the shuffle would find nothing more to merge). Texts are shuffled once, for both the windows and the result.

Words are WORD, as they are. Null texts have none. Ids are whole numbers, or text that can be read as such. A null id counts as greater than all others. Rows that repeat an id
are one document with regard to their windows; each is judged. Windows are judged on the input, so what is removed does
not change what else is. Extra columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.staging import drop

from .common import bounded_batches, mix64, stage, tidy, window_hashes

WIDTH, GRAM = 50, 10
#: Entries that a task remembers of what it has met.
REMEMBER = 150_000
#: Bytes of text, and windows, that are worked on at once; a longer text comes alone.
AT_ONCE, WINDOWS_AT_ONCE = 1 << 20, 300_000
#: Bytes from which on a word is hashed by itself.
LONG = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def least_grams(h: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """For each window of width words, the least hash of its runs of gram words."""
    low, span, need = window_hashes(h, gram), 1, width - gram + 1
    if len(low) < need:
        return np.empty(0, np.uint64)
    while span * 2 <= need:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    return np.minimum(low[: len(h) - width + 1], low[need - span :]) if span < need else low


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files; else they stay until the driver collects garbage, beside those of the result."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in docs.columns])
    return bounded_batches(docs).select(row.alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("did"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts whose UTF-8 lies in data from cut to cut, and between which of them each text's are.

    Bytes are taken eight at a time for all words at once; the few words beyond LONG bytes are hashed one by one.
    """
    data, cuts = data[cuts[0] : cuts[-1]], cuts - cuts[0]
    space = (data == 32) | (data - np.uint8(9) < 5)  # no byte of a longer character is one of these
    starts = ~space
    ends = starts.copy()
    starts[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    starts[inner], ends[inner - 1] = ~space[inner], ~space[inner - 1]
    first = np.flatnonzero(starts)
    size = np.flatnonzero(ends) + 1 - first
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=1)  # from each byte on
    h = mix64(mix64(size.astype(np.uint64)) ^ (eight[first] & _MASKS[np.minimum(size, 8)]))
    at, done = np.flatnonzero(size > 8), 8
    while len(at) and done < LONG:
        rest = size[at] - done
        h[at] = mix64(h[at] ^ (eight[first[at] + done] & _MASKS[np.minimum(rest, 8)]))
        at, done = at[rest > 8], done + 8
    for i in at.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[first[i] : first[i] + size[i]].tobytes())
    return h, np.searchsorted(first, cuts)


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some texts at a time: the number of the first, and their word_hashes."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, at = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + AT_ONCE, "right")) - 1)
        yield at, *word_hashes(data, cuts[at : end + 1])
        at = end


def _starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows within one text start, and the number of that text."""
    n = np.maximum(np.diff(bounds) - width + 1, 0)
    return np.arange(n.sum()) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n), np.repeat(np.arange(len(n)), n)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sizes(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(heads, n))


def gram_rows(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Of rows (did, h, text) the rows (did, h, g), each g of a text once."""
    for batch in batches:
        did, h = (batch.column(c).to_numpy() for c in ("did", "h"))
        for base, hashes, bounds in _hashed(batch.column("text")):
            at, text = _starts(bounds, width)
            g = least_grams(hashes, width, gram)[at]
            new = _heads(text, g)
            text, g = text[new], g[new]
            order = np.lexsort((g, text))
            text, g = text[order], g[order]
            new = _heads(text, g)
            text = text[new] + base
            yield pa.record_batch([pa.array(did[text]), pa.array(h[text]), pa.array(g[new].view(np.int64))], names=["did", "h", "g"])


class _Met:
    """Windows that a task has handed on, by w1: the least id that it has handed on with each, and in how many texts it has met it."""

    def __init__(self) -> None:
        self.w1, self.w2, self.least, self.seen = (np.empty(0, np.int64) for _ in range(4))

    def add(self, w1: np.ndarray, w2: np.ndarray, least: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Notes windows sorted by w1 and gives the least id of each, from now or before. Beyond REMEMBER those met in most texts stay."""
        at = np.searchsorted(self.w1, w1)
        at[at == len(self.w1)] = 0
        old = (self.w1[at] == w1) & (self.w2[at] == w2) if len(self.w1) else np.zeros(len(w1), bool)
        least, seen = least.copy(), seen.copy()
        least[old] = np.minimum(least[old], self.least[at[old]])
        seen[old] += self.seen[at[old]]
        other = np.ones(len(self.w1), bool)
        other[at[old]] = False
        w1, w2, low, seen = (np.append(x[other], y) for x, y in ((self.w1, w1), (self.w2, w2), (self.least, least), (self.seen, seen)))
        if len(w1) > REMEMBER:
            keep = np.flatnonzero(seen > 1)
            keep = keep[np.argsort(-seen[keep], kind="stable")[:REMEMBER]]
            w1, w2, low, seen = w1[keep], w2[keep], low[keep], seen[keep]
        order = np.argsort(w1, kind="stable")
        self.w1, self.w2, self.least, self.seen = w1[order], w2[order], low[order], seen[order]
        return least


def _judged(met: _Met, did: np.ndarray, h: np.ndarray, text: np.ndarray, pos: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> pa.RecordBatch:
    """The rows of window_rows for windows in the order of texts and places; did and h are those of texts."""
    rank = np.empty(len(did), np.int64)
    rank[np.argsort(did, kind="stable")] = np.arange(len(did))
    order = np.argsort(rank[text], kind="stable")
    order = order[np.argsort(w1[order], kind="stable")]  # by window, then id, text and place
    text, pos, w1, w2 = text[order], pos[order].astype(np.int32), w1[order], w2[order]
    window = _heads(w1, w2)
    n = _sizes(window, len(text))
    of = np.repeat(np.arange(len(window)), n)
    first = _heads(of, text)  # each window once a text
    least = met.add(w1[window], w2[window], did[text[window]], np.bincount(of[first], minlength=len(window)))
    known, n = did[text[first]] > least[of[first]], _sizes(first, len(text))
    new = first[~known]
    told = np.argsort(order[new], kind="stable")  # neighbours of one text stay together, which packs well
    new, times = new[told], n[~known][told]
    more = np.full(len(new), None, dtype=object)
    for i in np.flatnonzero(times > 1).tolist():  # words that go on repeating
        more[i] = pos[new[i] + 1 : new[i] + times[i]].tobytes()
    rows = np.flatnonzero(np.repeat(known, n))
    rows = rows[np.argsort(text[rows], kind="stable")]
    at = _heads(text[rows])
    texts = text[rows][at]
    places = [pos[x].tobytes() for x in np.split(rows, at[1:])] if len(at) else []
    columns = [
        (did[text[new]], did[texts]),
        (h[text[new]], h[texts]),
        (w1[new], h[texts]),
        (w2[new] | pos[new].astype(np.int64) << 32, did[texts] & 0xFFFF | -1 << 32),
    ]
    return pa.record_batch([*[pa.array(np.concatenate(x)) for x in columns], pa.array([*more, *places], pa.binary())], names=["did", "h", "w1", "at", "more"])


def window_rows(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Of rows (did, h, text, grams) the rows (did, h, w1, at, more) for windows still to be judged, one each for a document: the rest of its hash below where it starts first, and the other places as bytes.

    What the task could judge comes in one row a document, with all places in more and pos -1.
    """
    met = _Met()
    for batch in batches:
        did, h = (batch.column(c).to_numpy() for c in ("did", "h"))
        # a run that repeats in one text's list repeats in every text that has it
        grams, parts, n = np.unique(batch.column("grams").flatten().to_numpy()).view(np.uint64), [], 0
        for base, hashes, bounds in _hashed(batch.column("text")):
            at, text = _starts(bounds, width)
            low = least_grams(hashes, width, gram)[at]
            run = _heads(text, low)
            keep = np.repeat(np.isin(low[run], grams), _sizes(run, len(low)))
            at, text = at[keep], text[keep]
            w1 = window_hashes(hashes, width)[at].view(np.int64)
            w2 = (window_hashes(hashes, width, 0xD6E8FEB86659FD93)[at] >> np.uint64(32)).view(np.int64)
            parts.append((text + base, at - bounds[text], w1, w2))
            n += len(at)
            if n > WINDOWS_AT_ONCE:
                yield _judged(met, did, h, *map(np.concatenate, zip(*parts, strict=True)))
                parts, n = [], 0
        if n:
            yield _judged(met, did, h, *map(np.concatenate, zip(*parts, strict=True)))


def _grams_of(rows: DataFrame, width: int, gram: int) -> DataFrame:
    return rows.select("did", "h", "text").mapInArrow(tidy(lambda batches: gram_rows(batches, width, gram)), "did long, h long, g long")


def _windows_of(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """Rows (did, h, w1, w2, pos, more), dealt out by w1; until then w2 and pos are one column, as in window_rows."""
    dealt = rows.select("did", "h", "text", "grams").mapInArrow(tidy(lambda batches: window_rows(batches, width, gram)), "did long, h long, w1 long, at long, more binary").repartition("w1")
    return dealt.select("did", "h", "w1", F.expr("at & 4294967295L").alias("w2"), F.expr("cast(shiftright(at, 32) as int)").alias("pos"), "more")


def kept_words(text: bytes, positions: np.ndarray, width: int = WIDTH) -> tuple[int, int, bytes]:
    """Number of words, number removed, and what is left, joined by one space."""
    words = text.split()  # bytes split at what parts words of WORD and nothing else
    if not len(positions):
        return len(words), 0, b" ".join(words)
    n = len(words) + 1
    kept = (np.bincount(positions, minlength=n) - np.bincount(positions + width, minlength=n)).cumsum()[:-1] <= 0
    return len(words), len(words) - int(kept.sum()), b" ".join(compress(words, kept.tolist()))


def left_of(texts: pa.Array, pos: pa.Array, more: pa.Array, width: int, digest: bool) -> pa.Array:
    """Rows (words, removed, left) of texts with the places of windows that go, in pos and as bytes in more."""
    out = []
    for t, p, k in zip(texts.cast(pa.large_binary()), pos, more, strict=True):
        at = [p.values.to_numpy()] if p.is_valid and len(p) else []
        at += [np.frombuffer(x, np.int32) for x in k.as_py()] if k.is_valid and len(k) else []
        n, gone, rest = kept_words(t.as_py(), np.unique(np.concatenate(at)).astype(np.int64) if at else (), width)
        out.append((n, gone, hashlib.sha256(rest).hexdigest().encode() if digest else rest))
    n, gone, rest = zip(*out, strict=True) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(rest, pa.binary()).view(pa.string())], names=["words", "removed", "left"])


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """docs with dedup_words, dedup_removed and dedup_text (what is left; with digest its SHA-256 in hex)."""
    rows = _keyed(docs, key, text)
    grams = stage(_grams_of(rows, width, gram), "substring-grams")
    again = grams.groupBy("g").agg(F.min("did").alias("a"), F.max("did").alias("b")).where("a < b").select("g")
    with _shuffles_go(docs.sparkSession):
        lists = stage(grams.join(again, "g").groupBy("did", "h").agg(F.collect_set("g").alias("grams")), "substring-lists")
    drop(grams)
    windows = _windows_of(rows.join(lists.hint("shuffle_hash"), ["did", "h"]).select("did", "h", "text", "grams"), width, gram)
    least = F.expr("min(did) over (partition by w1, w2)")
    found = windows.withColumn("least", least).where("pos < 0 or did > least")
    found = found.groupBy("did", "h").agg(F.collect_list(F.when(F.col("pos") >= 0, F.col("pos"))).alias("pos"), F.collect_list("more").alias("more"))

    def left(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, pos, more in batches:
            yield left_of(texts, pos, more, width, digest)

    judged = rows.join(found.hint("shuffle_hash"), ["did", "h"], "left").select("_row", F.arrow_udf(tidy(left), "words long, removed long, left string")("text", "pos", "more").alias("x"))
    return judged.select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns], F.col("x.words").alias("dedup_words"), F.col("x.removed").alias("dedup_removed"), F.col("x.left").alias("dedup_text"))

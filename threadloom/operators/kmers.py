"""K-mer indexes and counts. Keys are the k-mers themselves, so no hash can mistake one for another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.dna import kmers, unpack
from threadloom.plans.staging import settle

#: The greatest count that is kept apart.
SATURATED = 2**22 - 1
#: Bases that one numpy step takes, and different k-mers that a task holds before it hands on what it has.
PIECE, HELD = 2_000_000, 2_000_000
#: The longest k-mer that is one number.
PACKED = 31
#: Bits of a k-mer's hash that tell its slice, which one task merges at once.
SLICE_BITS = 12


def unique_owner_index(sequences: DataFrame, k: int, max_pos: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """kmer, owner, pos, fwd of its first occurrence (least owner, then pos), and is_repeat if another owner has it.

    One aggregation with partial sums; a k-mer that occurs very often is merged before the shuffle. Owner, pos and fwd are
    one number, so that the aggregation is by hash and sorts nothing; owners and positions must be below 2^31. max_pos
    leaves out occurrences beyond a position; only, k-mers that it does not have.
    """
    occurrences = kmers(sequences, k)
    if only is not None:
        occurrences = occurrences.join(only.select("kmer"), "kmer", "left_semi")
    if max_pos is not None:
        occurrences = occurrences.where(F.col("pos") <= max_pos)
    fits = (F.col("owner") >= 0) & (F.col("owner") < 2**31) & (F.col("pos") < 2**31)
    place = F.when(fits, F.shiftleft(F.col("owner").cast("long"), 32) + F.col("pos").cast("long") * 2 + F.col("fwd").cast("long")).otherwise(F.raise_error(F.lit("owners and positions must be below 2^31")))
    index = occurrences.groupBy("kmer").agg(F.min(place).alias("p"), (F.min("owner") != F.max("owner")).alias("is_repeat"))
    low = F.col("p").bitwiseAND(F.lit(2**32 - 1))
    return index.select("kmer", F.shiftright("p", 32).alias("owner"), F.shiftright(low, 1).cast("int").alias("pos"), (low % 2 == 1).alias("fwd"), "is_repeat")


def all_occurrences(sequences: DataFrame, k: int) -> DataFrame:
    """kmer, owner, pos, fwd of every occurrence, for targets in which repeats count."""
    return kmers(sequences, k).select("kmer", "owner", "pos", "fwd")


def repeat_occurrences(sequences: DataFrame, k: int) -> DataFrame:
    """Occurrences of repeated k-mers in owners other than the first."""
    index = unique_owner_index(sequences, k).where("is_repeat").select("kmer", F.col("owner").alias("first_owner"))
    return all_occurrences(sequences, k).join(index, "kmer").where("owner <> first_owner").drop("first_owner")


def _packed(text: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, canonical number and fwd of every window of k bases of a text in capitals."""
    base = np.full(256, 4, np.uint8)
    base[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    code = base[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    broken = np.concatenate([[0], np.cumsum(code == 4, dtype=np.int32)])
    at = np.flatnonzero(broken[k:] == broken[:-k])
    kind = np.uint32 if k <= 16 else np.uint64
    step = (code & 3).astype(kind)
    fwd, back, size = step, 3 - step, 1  # of windows of size bases
    for bit in bin(k)[3:]:
        fwd, back = (fwd[:-size] << kind(2 * size)) | fwd[size:], (back[size:] << kind(2 * size)) | back[:-size]
        size *= 2
        if bit == "1":
            fwd, back = (fwd[:-1] << kind(2)) | step[size:], ((3 - step[size:]) << kind(2 * size)) | back[:-1]
            size += 1
    fwd, back = fwd[at], back[at]
    return at, np.minimum(fwd, back).astype(np.uint64), fwd < back


def _order(code: np.ndarray) -> np.ndarray:
    """What sorts codes. Where a code and its place fit one number, that is sorted, which is much faster."""
    bits = len(code).bit_length()
    if not len(code) or int(code.max()) >> (63 - bits):
        return np.argsort(code, kind="stable")
    return (np.sort((code << np.uint64(bits)) | np.arange(len(code), dtype=np.uint64)) & np.uint64(2**bits - 1)).astype(np.int64)


def _pieces(texts: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, pos, canonical number and fwd of the k-mers of texts, PIECE bases or so at a time; windows over a cut are whole in one of its sides."""
    held: list[tuple[int, int, str]] = []
    size = 0

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, code, fwd = _packed("N".join(t for _, _, t in held), k)
        starts = np.cumsum([0, *(len(t) + 1 for _, _, t in held[:-1])])
        which = np.searchsorted(starts, at, "right") - 1
        return np.array([r for r, _, _ in held])[which], at - starts[which] + np.array([o for _, o, _ in held])[which], code, fwd

    for row, text in enumerate(texts):
        text = text.upper()
        for cut in range(0, max(len(text) - k + 1, 0), PIECE):
            held.append((row, cut, text[cut : cut + PIECE + k - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield run()
                held, size = [], 0
    if held:
        yield run()


def _task_counts(batches: Iterator[pd.DataFrame], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of the k-mers of seq, whenever HELD different ones are held, and at the end."""
    codes, ns = np.empty(0, np.uint64), np.empty(0, np.int64)
    fresh: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        c, n = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (codes[:0], ns[:0])
        fresh.clear()
        both = np.concatenate([codes, c])
        order = _order(both)
        both, n = both[order], np.concatenate([ns, n])[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
        return both[first], np.add.reduceat(n, first) if len(first) else n

    for pdf in batches:
        for _, _, code, _ in _pieces(pdf["seq"].tolist(), k):
            fresh.append(code)
            if sum(map(len, fresh)) >= HELD:
                codes, ns = merged()
                if len(codes) >= HELD:
                    yield codes, ns
                    codes, ns = codes[:0], ns[:0]
    yield merged()


def _counted(sequences: DataFrame, k: int) -> DataFrame:
    """code, n: partial counts of each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for codes, ns in _task_counts(batches, k):
            yield pd.DataFrame({"code": codes.astype(np.int64), "n": ns})

    return sequences.where("seq is not null").select("seq").mapInPandas(run, "code long, n long")


def count_kmers(sequences: DataFrame, k: int, only: DataFrame | None = None, saturate: int = SATURATED) -> DataFrame:
    """kmer, n. only: k-mers to count; others are left out before they are shuffled to be counted.

    K-mers of up to 31 bases are counted as numbers within each task first, and named when they are counted.
    """
    if only is None and k <= PACKED:
        counts = _counted(sequences, k).groupBy("code").agg(F.least(F.sum("n"), F.lit(saturate)).alias("n"))
        return counts.select(unpack(F.col("code"), k).alias("kmer"), "n")
    found = kmers(sequences, k).select("kmer")
    if only is not None:
        found = found.join(only.select("kmer").distinct(), "kmer", "left_semi")
    return found.groupBy("kmer").agg(F.least(F.count("*"), F.lit(saturate)).alias("n"))


def kmer_totals(sequences: DataFrame, k: int, only: np.ndarray | None = None) -> DataFrame:
    """code (the packed k-mer), owner and pos of its first occurrence, n1 and sum1 (number and positions of its occurrences in that owner), n and sum (of all).

    What asks for sums over occurrences needs no row for each: a task sums up what it meets, and the least owner's share is
    told apart in each merge. only: sorted codes to keep. k is at most 31; owners must be from 0 to below 2^31.
    """
    names = ["code", "owner", "pos", "n1", "sum1", "n", "sum"]

    def merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        code, place, n1, s1, n, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = _order(code)
        code, place, n1, s1, n, s = (x[order] for x in (code, place, n1, s1, n, s))
        if not len(code):
            return code, place, n1, s1, n, s
        new = np.concatenate([[True], code[1:] != code[:-1]])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(place, first)
        own = (place >> 32) == (least >> 32)[np.cumsum(new) - 1]
        return code[first], least, *(np.add.reduceat(x, first) for x in (n1 * own, s1 * own, n, s))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        seen = None
        if only is not None:  # most k-mers fall through a small table of hashes
            mix = lambda c: (c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
            seen = np.zeros(2**22, bool)
            seen[mix(only)] = True

        def frame(x: tuple[np.ndarray, ...]) -> pd.DataFrame:
            code, place, n1, s1, n, s = x
            return pd.DataFrame({"code": code.astype(np.int64), "owner": place >> 32, "pos": place & (2**32 - 1), "n1": n1, "sum1": s1, "n": n, "sum": s})

        for pdf in batches:
            owners = pdf["owner"].to_numpy(np.int64)
            for row, pos, code, _ in _pieces(pdf["seq"].tolist(), k):
                if seen is not None:
                    maybe = np.flatnonzero(seen[mix(code)])
                    maybe = maybe[np.isin(code[maybe], only)]
                    row, pos, code = row[maybe], pos[maybe], code[maybe]
                one = np.ones(len(code), np.int64)
                parts.append(merge([(code, (owners[row] << 32) + pos, one, pos, one, pos)]))
                size += len(parts[-1][0])
                if size >= HELD:
                    parts = [merge(parts)]
                    size = len(parts[0][0])
                    if size >= HELD // 2:
                        yield frame(parts[0])
                        parts, size = [], 0
        if parts:
            yield frame(merge(parts))

    fits = F.col("owner").between(0, 2**31 - 1)
    owner = F.when(fits, F.col("owner").cast("long")).otherwise(F.raise_error(F.lit("owners must be from 0 to below 2^31"))).alias("owner")
    found = sequences.where("seq is not null").select(owner, "seq").mapInPandas(run, ", ".join(f"{c} long" for c in names))
    # one exchange, by code, does for both aggregations
    own = found.repartition("code").groupBy("code", "owner").agg(F.min("pos").alias("pos"), *[F.sum(c).alias(c) for c in names[3:]])
    least = F.min_by(F.struct("owner", "pos", "n1", "sum1"), "owner")
    return own.groupBy("code").agg(least.alias("x"), F.sum("n").alias("n"), F.sum("sum").alias("sum")).select("code", "x.owner", "x.pos", "x.n1", "x.sum1", "n", "sum")


def repeat_totals(sequences: DataFrame, k: int) -> DataFrame:
    """owner, n, sum_pos of repeat_occurrences: all occurrences in an owner but for those of k-mers that it has first."""
    if k > PACKED:
        return repeat_occurrences(sequences, k).groupBy("owner").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))
    first = kmer_totals(sequences, k).select("owner", (-F.col("n1")).alias("n"), (-F.col("sum1")).alias("sum_pos"))
    every = _owned(sequences, k)
    return every.unionByName(first).groupBy("owner").agg(F.sum("n").alias("n"), F.sum("sum_pos").alias("sum_pos")).where("n > 0")


def _owned(sequences: DataFrame, k: int) -> DataFrame:
    """owner, n, sum_pos of each row's windows of k bases, from the lengths of its runs of bases."""
    bases = bytes(c if c in b"ACGT" else ord("N") for c in range(256))

    def windows(text: str) -> tuple[int, int]:
        n = total = at = 0
        for run in text.upper().encode("ascii", "replace").translate(bases).split(b"N"):
            if (m := len(run) - k + 1) > 0:
                n, total = n + m, total + m * at + m * (m - 1) // 2
            at += len(run) + 1
        return n, total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, total = np.array([windows(t) for t in pdf["seq"]], np.int64).reshape(-1, 2).T
            yield pd.DataFrame({"owner": pdf["owner"], "n": n, "sum_pos": total})[n > 0]

    return sequences.where("seq is not null").select(F.col("owner").cast("long").alias("owner"), "seq").mapInPandas(run, "owner long, n long, sum_pos long")


def count_spectra(sequences: DataFrame, queries: DataFrame, k: int, saturate: int = SATURATED) -> tuple[DataFrame, DataFrame]:
    """(n, hist): k-mers of sequences (seq) by count; and (seq, n, cnt): windows of queries (owner, seq) by their k-mer's count there, 0 included.

    Tasks count packed k-mers and hand them on as slices of SLICES by hash, a row a slice, to be merged one slice at a time;
    no k-mer is a row of its own. k is at most 31.
    """
    schema = "slice int, asks boolean, codes binary, ns binary"
    names = ["slice", "asks", "codes", "ns"]

    def sliced(codes: np.ndarray, *others: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        of = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLICE_BITS)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(2**SLICE_BITS + 1))
        codes, *others = (x[order] for x in (codes, *others))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            yield i, tuple(x[bounds[i] : bounds[i + 1]] for x in (codes, *others))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for codes, ns in _task_counts(batches, k):
            yield pd.DataFrame([(i, False, c.tobytes(), n.tobytes()) for i, (c, n) in sliced(codes, ns)], columns=names)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owners = pdf["owner"].to_numpy(np.int64)
            for row, _, code, _ in _pieces(pdf["seq"].tolist(), k):
                yield pd.DataFrame([(i, True, c.tobytes(), o.tobytes()) for i, (c, o) in sliced(code, owners[row])], columns=names)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist: dict[int, int] = {}
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}
        now = None

        def close() -> None:
            codes, ns = (np.concatenate(x) for x in zip(*held[False], strict=True)) if held[False] else (np.empty(0, np.uint64), np.empty(0, np.int64))
            codes, at = np.unique(codes, return_inverse=True)
            ns = np.minimum(np.bincount(at, ns, len(codes)).astype(np.int64), saturate)
            for n, c in zip(*np.unique(ns, return_counts=True), strict=True):
                hist[int(n)] = hist.get(int(n), 0) + int(c)
            if held[True]:
                asked, owners = (np.concatenate(x) for x in zip(*held[True], strict=True))
                place = np.minimum(np.searchsorted(codes, asked), max(len(codes) - 1, 0))
                n = np.where(codes[place] == asked, ns[place], 0) if len(codes) else np.zeros(len(asked), np.int64)
                order = np.lexsort((n, owners))
                owners, n = owners[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(owners) != 0) | (np.diff(n) != 0)]))
                found.append((owners[first], n[first], np.diff(first, append=len(n))))
            held[False].clear()
            held[True].clear()

        def out() -> pd.DataFrame:
            seq, n, cnt = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            return pd.DataFrame({"seq": pd.array(seq, "Int64"), "n": n, "cnt": cnt})

        for pdf in batches:
            for i, asks, c, n in zip(pdf["slice"].tolist(), pdf["asks"].tolist(), pdf["codes"], pdf["ns"], strict=True):
                if i != now and now is not None:
                    close()
                now = i
                held[asks].append((np.frombuffer(c, np.uint64), np.frombuffer(n, np.int64)))
            if sum(len(x[0]) for x in found) >= HELD // 8:
                yield out()
        close()
        if found:
            yield out()
        if hist:
            yield pd.DataFrame({"seq": pd.array([None] * len(hist), "Int64"), "n": list(hist), "cnt": list(hist.values())})

    rows = sequences.where("seq is not null").select("seq").mapInPandas(count, schema)
    asked = queries.where("seq is not null and owner is not null").select(F.col("owner").cast("long").alias("owner"), "seq").mapInPandas(ask, schema)
    merged = rows.unionByName(asked).repartition("slice").sortWithinPartitions("slice").mapInPandas(merge, "seq long, n long, cnt long")
    both = settle(merged.groupBy("seq", "n").agg(F.sum("cnt").alias("cnt")), "spectra")
    return both.where("seq is null").select("n", F.col("cnt").alias("hist")), both.where("seq is not null")


def seen_before(counts: DataFrame) -> DataFrame:
    """K-mers met at least twice, as a filter that absorbs first sightings would leave them."""
    return counts.where("n >= 2")


def count_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n").agg(F.count("*").alias("kmers"))


def shrink(counts: DataFrame, least: int, most: int) -> DataFrame:
    """Counts from least to most, both included."""
    return counts.where(F.col("n").between(least, most))


def clear_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("n", F.lit(0).cast("long"))


def trio_bins(a: DataFrame, b: DataFrame, least: int, middle: int) -> DataFrame:
    """kmer and flags: from the first table 1 (least) or 2 (middle), from the second 4 or 8; k-mers below least in both go."""

    def bins(df: DataFrame, name: str, shift: int) -> DataFrame:
        return df.select("kmer", F.when(F.col("n") >= middle, 2 << shift).when(F.col("n") >= least, 1 << shift).otherwise(0).alias(name))

    both = bins(a, "x", 0).join(bins(b, "y", 2), "kmer", "full_outer")
    return both.select("kmer", F.coalesce("x", F.lit(0)).bitwiseOR(F.coalesce("y", F.lit(0))).cast("int").alias("flags")).where("flags > 0")


def look_up(queries: DataFrame, index: DataFrame, repeats: bool = False) -> DataFrame:
    """Rows of queries with their k-mer's entry; without repeats, entries of one owner only."""
    return queries.join(index if repeats else index.where("not is_repeat"), "kmer")


def class_quality_kmers(reads: DataFrame, k: int, mark: str = "H") -> DataFrame:
    """owner, pos, kmer, fwd of windows whose last base has the quality mark; reads (owner, seq, qual)."""
    even = reads.where(F.length("qual") == F.length("seq"))
    found = kmers(even, k, keep=("owner", "qual"))
    return found.where(F.substring(F.col("qual"), F.col("pos") + k, F.lit(1)) == mark).drop("qual", "raw")

"""Functions on sequences of bases. Bases other than A, C, G and T break runs of k-mers."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = string.ascii_lowercase + string.ascii_uppercase
_AS_BASES = ("ACGT" * 7)[:26] * 2
#: Characters of a sequence that one step of k-mer extraction takes; substring() walks from the start of its text.
CHUNK = 256


def base_code(base: Column) -> Column:
    """A, C, G, T or U of either case to 0, 1, 2, 3, 3; all else to 4."""
    at = F.instr(F.lit("ACGT"), F.translate(F.upper(base), "U", "T"))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4).cast("int")


def text_as_bases(text: Column) -> Column:
    """Letters a to z to bases in turn; other characters go. This gives plain texts a sequence to map."""
    return F.regexp_replace(F.translate(text, _LETTERS, _AS_BASES), "[^ACGT]", "")


_TO_BASES = bytes(range(256)).translate(bytes.maketrans(_LETTERS.encode(), _AS_BASES.encode()))
_NO_LETTERS = bytes(set(range(256)) - set(_LETTERS.encode()))


def texts_as_bases(text: Column) -> Column:
    """text_as_bases in Python, for large tables: translate() looks every character up in a map."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t.encode("ascii", "ignore").translate(_TO_BASES, _NO_LETTERS).decode("ascii"), na_action="ignore")

    return run(text)


def reverse_complement(seq: Column) -> Column:
    """In capitals; anything but a base becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def oriented(seq: Column, vertex: Column) -> Column:
    """The sequence, or its reverse complement for an odd vertex."""
    return F.when(vertex % 2 == 1, reverse_complement(seq)).otherwise(seq)


def pack(kmer: Column) -> Column:
    """Up to 31 bases as a number, two bits each, the first base highest."""
    return F.aggregate(F.split(kmer, ""), F.lit(0).cast("long"), lambda n, b: F.shiftleft(n, 2) + (F.instr(F.lit("ACGT"), b) - 1).cast("long"))


def unpack(code: Column, k: int) -> Column:
    """The k bases of a packed number."""
    return F.array_join(F.array(*[F.substring(F.lit("ACGT"), F.shiftright(code, 2 * i).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for i in range(k - 1, -1, -1)]), "")


def kmers(df: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ("owner",)) -> DataFrame:
    """Every window of k bases: kept columns, pos (from 0), kmer (the lesser of it and its reverse complement), fwd, raw.

    Sequences are cut into overlapping chunks first, so the work is in proportion to their length, and a long sequence
    is not one row by the time it matters.
    """
    df = df.withColumn(seq, F.regexp_replace(F.upper(seq), "[^ACGT]", "N"))
    n = F.length(seq)
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k, F.lit(CHUNK)))
    chunks = df.where(n >= k).select(*keep, F.explode(starts).alias("_at"), F.col(seq).alias("_s"))
    chunks = chunks.select(*keep, "_at", F.substring(F.col("_s"), F.col("_at") + 1, F.lit(CHUNK + k - 1)).alias("_c"))
    chunks = chunks.withColumn("_r", reverse_complement(F.col("_c")))
    # windows are cut inside the array, so exploded rows carry two windows and not their whole chunk
    last = F.length("_c") - k
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.substring(F.col("_c"), i + 1, F.lit(k)).alias("raw"), F.substring(F.col("_r"), last - i + 1, F.lit(k)).alias("rc")))
    at = chunks.select(*keep, "_at", F.explode(windows).alias("_w"))
    at = at.select(*keep, (F.col("_at") + F.col("_w.i")).alias("pos"), F.col("_w.raw").alias("raw"), F.col("_w.rc").alias("_rc"))
    at = at.where(~F.col("raw").contains("N"))
    return at.select(*keep, "pos", F.least("raw", "_rc").alias("kmer"), (F.col("raw") < F.col("_rc")).alias("fwd"), "raw")

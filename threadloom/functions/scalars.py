"""Scalar functions on overlaps, numbers with suffixes, chromosome names, intervals and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cigar_sum(cigar: Column, kinds: str) -> Column:
    runs = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def cigar_lengths(cigar: Column) -> tuple[Column, Column]:
    """Length on the first sequence (M, D, N) and on the second (M, I, S)."""
    return _cigar_sum(cigar, "MDN"), _cigar_sum(cigar, "MIS")


def parse_number(text: Column) -> Column:
    """1.5K to 1500; K, M and G of either case count thousands, millions and thousands of millions; rounded half up."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+(?:[eE][-+]?[0-9]+)?)", 1).cast("double")
    suffix = F.upper(F.regexp_extract(text, r"([kKmMgG])\s*$", 1))
    times = F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "G", 1e9).otherwise(1.0)
    return F.floor(number * times + 0.499).cast("long")


def base_chromosome(name: Column) -> Column:
    """A name without its haplotype word (the misspelt ones too) and without underscores at its ends."""
    return F.regexp_replace(F.regexp_replace(name, "(?i)MATERNAL|PATERNAL|MATERAL|PATERAL", ""), "^_+|_+$", "")


def haplotype(name: Column) -> Column:
    return F.when(F.upper(name).contains("MAT"), "MAT").when(F.upper(name).contains("PAT"), "PAT").otherwise("UNK")


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def length_difference(a: Column, b: Column) -> Column:
    """Share of the greater length by which two lengths differ; 0 where both are 0."""
    return F.when(F.greatest(a, b) == 0, 0.0).otherwise(F.abs(a - b) / F.greatest(a, b))


def name_number(name: Column) -> Column:
    """The number in the fourth to twelfth character of a unitig's name."""
    return F.substring(name, 4, 9).try_cast("int")


def consensus_quality(total: Column, found: Column, k: int) -> Column:
    """Phred-like quality from k-mers found among all: 99 if all, 0 if none, -1 without any k-mer."""
    return F.when(total == 0, -1.0).when(found == total, 99.0).when(found == 0, 0.0).otherwise(-10 * F.log10(F.log(total / found) / k))


def mapping_quality(anchors: Column) -> Column:
    """0 below 5 anchors, 60 above 20, else rising to 59 at most."""
    rising = F.floor(1 + (anchors - 5) * 58 / 25).cast("int")
    return F.when(anchors < 5, 0).when(anchors > 20, 60).otherwise(F.least(rising, F.lit(59))).cast("int")


def fragment_quality(anchors: Column, size: Column) -> Column:
    return F.when(size == 0, 0).otherwise(F.least(F.lit(60), F.floor(60 * anchors / size).cast("int"))).cast("int")


def synthetic_matches(query_span: Column, target_span: Column) -> Column:
    return F.floor(F.greatest(query_span, target_span) * 0.85).cast("long")


def minimum_hash(kmer: Column, reverse: Column, seed: int = 7) -> Column:
    """The lesser hash of a k-mer and its reverse complement; the values are this library's own."""
    return F.least(F.xxhash64(kmer, F.lit(seed)), F.xxhash64(reverse, F.lit(seed)))

"""Minimizers, modimizers and the joins and blocks made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.dna import kmers


def _runs(df: DataFrame, value: str) -> DataFrame:
    """Rows (seq_id, pos, value) to runs of one value at neighbouring positions: seq_id, start, end, minimizer."""
    order = Window.partitionBy("seq_id").orderBy("pos")
    new = F.when((F.lag(value).over(order) == F.col(value)) & (F.lag("pos").over(order) == F.col("pos") - 1), 0).otherwise(1)
    run = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("seq_id", "_run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first(value).alias("minimizer")).drop("_run")


def minimizer_runs(sequences: DataFrame, m: int, w: int, canonical: bool = False) -> DataFrame:
    """For each window of w start positions the least m-mer (of the two strands if canonical), as runs of window starts."""
    at = kmers(sequences, m, keep=("seq_id",)).select("seq_id", "pos", F.col("kmer" if canonical else "raw").alias("x"))
    ahead = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(0, w - 1)
    low = at.withColumn("low", F.min("x").over(ahead)).withColumn("_n", F.count("*").over(ahead)).where(F.col("_n") == w)
    return _runs(low.select("seq_id", "pos", "low"), "low")


def modimizers(sequences: DataFrame, k: int, w: int) -> DataFrame:
    """seq_id, pos, hash, fwd of canonical k-mers whose hash is a multiple of w."""
    return kmers(sequences, k, keep=("seq_id",)).select("seq_id", "pos", F.xxhash64("kmer").alias("hash"), "fwd").where(F.pmod("hash", F.lit(w)) == 0)


def clip_runs(runs: DataFrame, start: int, end: int) -> DataFrame:
    """The parts of runs within [start, end)."""
    return runs.where((F.col("end") > start) & (F.col("start") < end)).select("seq_id", F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end"), "minimizer")


def bag_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, shared: sum over common minimizers of the lesser span. a, b: seq_id, minimizer, span."""
    x = a.select(F.col("seq_id").alias("a_id"), "minimizer", F.col("span").alias("s1"))
    y = b.select(F.col("seq_id").alias("b_id"), "minimizer", F.col("span").alias("s2"))
    return x.join(y, "minimizer").groupBy("a_id", "b_id").agg(F.sum(F.least("s1", "s2")).alias("shared"))


def profile_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, product: sum over common minimizers of the product of shares."""
    x = a.select(F.col("seq_id").alias("a_id"), "minimizer", F.col("share").alias("s1"))
    y = b.select(F.col("seq_id").alias("b_id"), "minimizer", F.col("share").alias("s2"))
    return x.join(y, "minimizer").groupBy("a_id", "b_id").agg(F.sum(F.col("s1") * F.col("s2")).alias("product"))


def seed_blocks(seeds: DataFrame, drift: int = 50, least: int = 3) -> DataFrame:
    """Seeds (read, qpos, ref, tpos, fwd) to blocks read, ref, fwd, qstart, qend, tstart, tend, n of at least least seeds.

    A block ends where the reference or the direction changes, or the diagonal drifts by more than drift.
    """
    order = Window.partitionBy("read").orderBy("qpos", "ref", "tpos")
    diagonal = F.when(F.col("fwd"), F.col("tpos") - F.col("qpos")).otherwise(F.col("tpos") + F.col("qpos"))
    s = seeds.withColumn("d", diagonal)
    same = (F.lag("ref").over(order) == F.col("ref")) & (F.lag("fwd").over(order) == F.col("fwd")) & (F.abs(F.col("d") - F.lag("d").over(order)) <= drift)
    s = s.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_block", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("read", "_block").agg(
        F.first("ref").alias("ref"), F.first("fwd").alias("fwd"), F.min("qpos").alias("qstart"), F.max("qpos").alias("qend"), F.min("tpos").alias("tstart"), F.max("tpos").alias("tend"), F.count("*").alias("n"),
    )
    return g.where(F.col("n") >= least).drop("_block")


def distinct_everywhere(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, start, end of offsets at which all sequences of a group have minimizers and no two the same, merged. groups: seq_id, grp, one row a sequence."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
    at = runs.join(groups, "seq_id").select("grp", "minimizer", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    good = at.groupBy("grp", "pos").agg(F.count("*").alias("n"), F.count_distinct("minimizer").alias("d")).join(sizes, "grp").where((F.col("n") == F.col("size")) & (F.col("d") == F.col("size")))
    return _runs(good.select(F.col("grp").alias("seq_id"), "pos", F.lit("x").alias("x")), "x").select(F.col("seq_id").alias("grp"), "start", "end")

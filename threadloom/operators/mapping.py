"""Mapping reads to targets by anchors: probe, strand vote, order filter, support, best target; pairs to contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.dna import kmers, pack
from threadloom.operators.kmers import PACKED, all_occurrences, kmer_totals, unique_owner_index
from threadloom.plans.staging import settle

#: K-mers of reads that are broadcast to the targets, at most; more of them meet by shuffle.
BROADCAST_KMERS = 500_000
NEAR, SHIFT, LEAST_HITS, BONUS = 3, 200, 3, 20


def anchor_hits(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """read_idx, target, hit_seq, qpos, tpos, strand (the same or not), from k-mers with one owner.

    Reads and index meet by k-mer; repeats are dropped from the index before the join.
    """
    probes = kmers(reads, k, keep=("read_idx",)).select("read_idx", "kmer", F.col("pos").alias("qpos"), F.col("fwd").alias("qfwd"))
    single = index.where("not is_repeat").select("kmer", F.col("owner").alias("target"), F.col("pos").alias("tpos"), F.col("fwd").alias("tfwd"))
    return probes.join(single, "kmer").select("read_idx", "target", "kmer", F.col("qpos").alias("hit_seq"), "qpos", "tpos", (F.col("qfwd") == F.col("tfwd")).alias("strand"))


def anchor_hits_with_repeats(reads: DataFrame, index: DataFrame, occurrences: DataFrame, k: int) -> DataFrame:
    """As anchor_hits, and repeated k-mers hit all their occurrences."""
    probes = kmers(reads, k, keep=("read_idx",)).select("read_idx", "kmer", F.col("pos").alias("qpos"), F.col("fwd").alias("qfwd"))
    repeated = index.where("is_repeat").select("kmer")
    every = occurrences.join(repeated, "kmer", "left_semi").select("kmer", F.col("owner").alias("target"), F.col("pos").alias("tpos"), F.col("fwd").alias("tfwd"))
    more = probes.join(every, "kmer").select("read_idx", "target", "kmer", F.col("qpos").alias("hit_seq"), "qpos", "tpos", (F.col("qfwd") == F.col("tfwd")).alias("strand"))
    return anchor_hits(reads, index, k).unionByName(more)


def hit_totals(reads: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """read_idx, n, sum_t: number and target positions of anchor_hits_with_repeats, without a row for each hit.

    Targets are summed up by k-mer first: all occurrences of a repeated one, else the first. Up to BROADCAST_KMERS k-mers
    of reads go to the targets, so that only these are summed up; with more of them all are.
    """
    if k > PACKED:
        h = anchor_hits_with_repeats(reads, unique_owner_index(targets, k), all_occurrences(targets, k), k)
        return h.groupBy("read_idx").agg(F.count("*").alias("n"), F.sum("tpos").alias("sum_t"))
    probes = settle(kmers(reads, k, keep=("read_idx",)).select("read_idx", pack(F.col("kmer")).alias("code")))
    known = probes.select("code").distinct().limit(BROADCAST_KMERS + 1).toPandas()["code"].to_numpy("uint64")
    known.sort()
    totals = kmer_totals(targets, k, known if len(known) <= BROADCAST_KMERS else None)
    again = F.col("n") > F.col("n1")
    totals = totals.select("code", F.when(again, F.col("n")).otherwise(1).alias("n"), F.when(again, F.col("sum")).otherwise(F.col("pos")).alias("sum_t"))
    return probes.join(totals, "code").groupBy("read_idx").agg(F.sum("n").alias("n"), F.sum("sum_t").alias("sum_t"))


def majority_strand(hits: DataFrame) -> DataFrame:
    """Hits on their read and target's commoner strand; a tie goes to the opposite one. same: that strand."""
    group = Window.partitionBy("read_idx", "target")
    same = F.sum(F.when(F.col("strand"), 1).otherwise(-1)).over(group) > 0
    return hits.withColumn("same", same).where("strand = same")


def _wrong(dq: Column, dt: Column, same: Column) -> Column:
    """A later hit (by dq, dt) does not follow an earlier one."""
    return (dq <= 0) | F.when(same, dt <= 0).otherwise(dt >= 0) | (F.abs(F.abs(dq) - F.abs(dt)) > SHIFT)


def colinear(hits: DataFrame, strict: bool = False) -> DataFrame:
    """Hits whose neighbours bear out their order.

    With six hits or more, each is compared with the next three (the last three with those before them). With three to
    five all others vote: a later one must lie further on both, an earlier one further back. strict tests earlier hits of
    the opposite strand as the original rule does, by which three to five of them can never map. Fewer hits go.
    """
    order = Window.partitionBy("read_idx", "target").orderBy("hit_seq", "tpos")
    group = Window.partitionBy("read_idx", "target")
    h = hits.withColumn("n", F.count("*").over(group)).withColumn("i", F.row_number().over(order))
    h = h.where(F.col("n") >= LEAST_HITS)
    score, few = F.lit(0), F.lit(0)
    same = F.col("same")
    for d in (1, 2, 3, 4):
        q2, t2 = F.lead("qpos", d).over(order), F.lead("tpos", d).over(order)
        q0, t0 = F.lag("qpos", d).over(order), F.lag("tpos", d).over(order)
        if d <= NEAR:
            ahead = F.when(_wrong(q2 - F.col("qpos"), t2 - F.col("tpos"), same), -1).otherwise(1)
            back = F.when(_wrong(F.col("qpos") - q0, F.col("tpos") - t0, same), -1).otherwise(1)
            score = score + F.when(F.col("i") <= F.col("n") - NEAR, ahead).otherwise(back)
        far = lambda q, t: F.abs(F.abs(q - F.col("qpos")) - F.abs(t - F.col("tpos"))) > SHIFT
        later = F.when((q2 > F.col("qpos")) & F.when(same, t2 > F.col("tpos")).otherwise(t2 < F.col("tpos")) & ~far(q2, t2), 1).otherwise(-1)
        before = F.when(same, (q0 < F.col("qpos")) & (t0 < F.col("tpos"))).otherwise((F.lit(not strict) & (q0 < F.col("qpos"))) & (t0 > F.col("tpos")))
        earlier = F.when(before & ~far(q0, t0), 1).otherwise(-1)
        few = few + F.when(q2.isNull(), 0).otherwise(later) + F.when(q0.isNull(), 0).otherwise(earlier)
    kept = F.when(F.col("n") >= 2 * NEAR, score > 0).otherwise(few > 0)
    return h.withColumn("_kept", kept).where("_kept").drop("_kept", "n", "i")


def target_support(hits: DataFrame, k: int, bonus: int = BONUS, least: int = LEAST_HITS) -> DataFrame:
    """read_idx, target, same, hits, support, qstart, qend, tstart, tend.

    support: 1 and one for each neighbouring pair that lies k or more apart on both, and one for each bonus hits where
    there are more. Groups below least hits go.
    """
    order = Window.partitionBy("read_idx", "target").orderBy("hit_seq", "tpos")
    apart = (F.abs(F.col("qpos") - F.lag("qpos").over(order)) >= k) & (F.abs(F.col("tpos") - F.lag("tpos").over(order)) >= k)
    g = hits.withColumn("_apart", F.when(apart, 1).otherwise(0)).groupBy("read_idx", "target", "same")
    n = F.count("*")
    support = F.sum("_apart") + 1 + F.when(n > bonus, F.floor(n / bonus)).otherwise(0)
    out = g.agg(n.alias("hits"), support.cast("long").alias("support"), F.min("qpos").alias("qstart"), F.max("qpos").alias("qend"), F.min("tpos").alias("tstart"), F.max("tpos").alias("tend"))
    return out.where(F.col("hits") >= least)


def best_target(support: DataFrame) -> DataFrame:
    """Per read the target with the most support, the least id of equals."""
    key = F.struct(F.col("support"), (-F.col("target")).alias("t"))
    best = support.groupBy("read_idx").agg(F.max_by(F.struct("target", "same", "hits", "support", "qstart", "qend", "tstart", "tend"), key).alias("b"))
    return best.select("read_idx", "b.*")


def map_reads(reads: DataFrame, targets: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """reads (read_idx, seq) to their best target among targets (owner, seq)."""
    # k-mers of targets that no read has are left out of the index; where those of reads are few, before any shuffle
    asked = settle(kmers(reads, k, keep=("read_idx",)).select("kmer").distinct())
    index = unique_owner_index(targets, k, only=F.broadcast(asked) if asked.count() <= BROADCAST_KMERS else asked)
    return best_target(target_support(colinear(majority_strand(anchor_hits(reads, index, k)), strict), k))


def best_haplotype(first: DataFrame, second: DataFrame) -> DataFrame:
    """From support on two haplotypes, that with the larger best group of hits for each read; the first of equals."""
    both = first.withColumn("hap", F.lit(1)).unionByName(second.withColumn("hap", F.lit(2)))
    top = both.groupBy("read_idx").agg(F.max_by("hap", F.struct("hits", (-F.col("hap")).alias("h"))).alias("hap"))
    return both.join(top, ["read_idx", "hap"])


def unique_in_group(hits: DataFrame) -> DataFrame:
    """Hits whose k-mer occurs once in their read and target."""
    return hits.withColumn("_n", F.count("*").over(Window.partitionBy("read_idx", "target", "kmer"))).where("_n = 1").drop("_n")


def span_filter(support: DataFrame, min_len: int, least_ratio: float = 0.5) -> DataFrame:
    """Alignments with spans alike in length, at least two apart hits, and a tenth of min_len."""
    q, t = F.col("qend") - F.col("qstart"), F.col("tend") - F.col("tstart")
    return support.where((F.least(q, t) >= least_ratio * F.greatest(q, t)) & (F.col("support") >= 2) & (q >= min_len / 10))


def zip_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mapped mates by ordinal: read_idx, u1, fwd1, u2, fwd2. Reads of which one mate is unmapped go."""
    a = first.where("target is not null").select("read_idx", F.col("target").alias("u1"), F.col("same").alias("fwd1"))
    b = second.where("target is not null").select("read_idx", F.col("target").alias("u2"), F.col("same").alias("fwd2"))
    return a.join(b, "read_idx")


def group_guard(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs without those whose units are in two different groups other than 0; a unit in no group passes."""
    g1, g2 = (groups.select(F.col("id").alias(f"u{i}"), F.col("grp").alias(f"g{i}")) for i in (1, 2))
    joined = pairs.join(g1, "u1", "left").join(g2, "u2", "left")
    apart = (F.coalesce("g1", F.lit(0)) != 0) & (F.coalesce("g2", F.lit(0)) != 0) & (F.col("g1") != F.col("g2"))
    return joined.where(~apart).drop("g1", "g2")


def contacts(pairs: DataFrame) -> DataFrame:
    """i, j (i > j), fwd, bwd: pairs of different units, by whether their orientations agree."""
    agree = F.col("fwd1") == F.col("fwd2")
    other = pairs.where("u1 <> u2").select(F.greatest("u1", "u2").alias("i"), F.least("u1", "u2").alias("j"), agree.alias("a"))
    return other.groupBy("i", "j").agg(F.count_if("a").alias("fwd"), F.count_if(~F.col("a")).alias("bwd"))


def coverage(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u1", "u2")).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


def symmetric_total(table: DataFrame) -> DataFrame:
    """i, j, total in both directions: all contacts of a pair, from either."""
    t = table.select("i", "j", (F.col("fwd") + F.col("bwd")).alias("n"))
    return t.union(t.select("j", "i", "n")).groupBy("i", "j").agg(F.sum("n").alias("total"))


def run_statistics(first: DataFrame, second: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: mapped reads of each side, pairs with both mapped, in different units, and those skipped by group."""
    mates = first.select("read_idx", F.col("target").alias("u1")).join(second.select("read_idx", F.col("target").alias("u2")), "read_idx", "full_outer")
    g1, g2 = (groups.select(F.col("id").alias(f"u{i}"), F.col("grp").alias(f"g{i}")) for i in (1, 2))
    apart = (F.coalesce("g1", F.lit(0)) != 0) & (F.coalesce("g2", F.lit(0)) != 0) & (F.col("g1") != F.col("g2"))
    useful = F.col("u1") != F.col("u2")
    count = lambda what, name: F.coalesce(F.count_if(what), F.lit(0)).alias(name)
    return mates.join(g1, "u1", "left").join(g2, "u2", "left").agg(
        count(F.col("u1").isNotNull(), "mapped1"), count(F.col("u2").isNotNull(), "mapped2"), count(F.col("u1").isNotNull() & F.col("u2").isNotNull(), "both_mapped"),
        count(useful, "useful"), count(useful & ~apart, "kept"), count(useful & apart, "skipped"),
    )

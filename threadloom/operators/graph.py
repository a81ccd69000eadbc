"""Operators on a bidirected graph: arcs (v, w, ol, arc_len) between vertices 2 x segment + orientation.

Every operator here commutes with taking complements (v, w) to (w ^ 1, v ^ 1) unless its text says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.components import connected


def flipped(v: Column) -> Column:
    """The other orientation of a vertex."""
    return v.bitwiseXOR(F.lit(1))


def segment_of(v: Column) -> Column:
    return F.shiftright(v, 1)


def vertices_of(segments: DataFrame) -> DataFrame:
    """Both orientations of each segment, with its length."""
    return segments.select("seg_id", "len", F.explode(F.array(F.lit(0), F.lit(1))).alias("o")).select((F.col("seg_id") * 2 + F.col("o")).alias("v"), "seg_id", "len")


def arcs_from_links(links: DataFrame) -> DataFrame:
    """Links (v, w, ov, ow) to arcs; an arc's overlap is the one on its target."""
    return links.select("v", "w", F.col("ow").alias("ol"))


def close_complements(arcs: DataFrame) -> DataFrame:
    """arcs and the complement of each that lacks one of the same overlap."""
    mirror = arcs.select(flipped(F.col("w")).alias("v"), flipped(F.col("v")).alias("w"), "ol").distinct()
    return arcs.select("v", "w", "ol").unionByName(mirror.join(arcs.select("v", "w", "ol"), ["v", "w", "ol"], "left_anti"))


def drop_asymmetric(arcs: DataFrame) -> DataFrame:
    """Arcs whose complement (of any overlap) is there."""
    mirror = arcs.select(flipped(F.col("w")).alias("v"), flipped(F.col("v")).alias("w")).distinct()
    return arcs.join(mirror, ["v", "w"], "left_semi")


def fit_arc_lengths(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """Overlaps cut to the source's length, arc_len as what is left of it; arcs of which an end is no segment go."""
    ends = segments.select(F.col("seg_id"), F.col("len"))
    a = arcs.withColumn("seg_id", segment_of(F.col("v"))).join(ends, "seg_id").drop("seg_id")
    a = a.withColumn("seg_id", segment_of(F.col("w"))).join(ends.select("seg_id"), "seg_id", "left_semi").drop("seg_id")
    ol = F.least("ol", "len")
    return a.select("v", "w", ol.alias("ol"), (F.col("len") - ol).alias("arc_len"))


def finalize(links: DataFrame, segments: DataFrame) -> DataFrame:
    """A read graph made ready: complements, then lengths."""
    return fit_arc_lengths(close_complements(arcs_from_links(links)), segments)


def one_arc_each(arcs: DataFrame) -> DataFrame:
    """One arc for each (v, w): that with the least arc_len, thus the largest overlap."""
    return arcs.groupBy("v", "w").agg(F.min(F.struct("arc_len", "ol")).alias("a")).select("v", "w", "a.ol", "a.arc_len")


def symmetrise(arcs: DataFrame) -> DataFrame:
    return drop_asymmetric(one_arc_each(arcs))


def cut_arcs(arcs: DataFrame, cut: DataFrame) -> DataFrame:
    """arcs without those named (v, w)."""
    return arcs.join(cut.select("v", "w").distinct(), ["v", "w"], "left_anti")


def remove_segments(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    """arcs without those that touch a segment of gone (seg_id)."""
    ids = gone.select("seg_id").distinct()
    for end in ("v", "w"):
        arcs = arcs.withColumn("seg_id", segment_of(F.col(end))).join(ids, "seg_id", "left_anti").drop("seg_id")
    return arcs


def degrees(arcs: DataFrame) -> DataFrame:
    """v, n_out, n_in; each arc counts once out of v and once, as its complement, into w."""
    ends = arcs.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("w").alias("x"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.x").alias("v")).agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def remove_two_cycles(arcs: DataFrame) -> DataFrame:
    """arcs without v <-> w where v has one arc in and one out and both lead to w."""
    single = degrees(arcs).where("n_out = 1 and n_in = 1").select("v")
    out = arcs.join(single, "v", "left_semi").select("v", "w")
    back = arcs.select(F.col("w").alias("v"), F.col("v").alias("w"))
    pairs = out.join(back, ["v", "w"], "left_semi").where("v <> w")
    v, w = F.col("v"), F.col("w")
    cut = pairs.select(F.explode(F.array(*[F.struct(a.alias("v"), b.alias("w")) for a, b in ((v, w), (w, v), (flipped(w), flipped(v)), (flipped(v), flipped(w)))])).alias("c")).select("c.v", "c.w")
    return cut_arcs(arcs, cut)


def tips_and_knots(arcs: DataFrame) -> DataFrame:
    """v, tip (arcs in but none out: with it, its other orientation), knot (more than two arcs each way)."""
    d = degrees(arcs)
    tips = d.where("n_out = 0 and n_in > 0").select(F.explode(F.array(F.col("v"), flipped(F.col("v")))).alias("v")).distinct().withColumn("tip", F.lit(True))
    return d.join(tips, "v", "left").select("v", F.coalesce("tip", F.lit(False)).alias("tip"), ((F.col("n_in") > 2) & (F.col("n_out") > 2)).alias("knot"))


def linear_vertices(arcs: DataFrame, typed: DataFrame) -> DataFrame:
    """Vertices with one arc each way that typed (v, node_type) leaves at 0 or out."""
    d = degrees(arcs).where("n_out = 1 and n_in = 1")
    return d.join(typed.where("node_type <> 0"), "v", "left_anti").select("v")


def simple_bubbles(arcs: DataFrame) -> DataFrame:
    """s, a, b, t (a < b): s leads to a and b alone, and each of these comes from s alone and leads to t alone; t doesn't lead to s."""
    d = degrees(arcs)
    inner = d.where("n_out = 1 and n_in = 1").select("v")
    forks = d.where("n_out = 2").select(F.col("v").alias("s"))
    into = arcs.select(F.col("v").alias("s"), F.col("w").alias("m"))
    out = arcs.select(F.col("v").alias("m"), F.col("w").alias("t"))
    middle = into.join(forks, "s", "left_semi").join(inner.withColumnRenamed("v", "m"), "m", "left_semi").join(out, "m")
    both = middle.groupBy("s", "t").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count("*").alias("n")).where("n = 2 and a <> b")
    only = d.where("n_in = 2").select(F.col("v").alias("t"))
    back = arcs.select(F.col("v").alias("t"), F.col("w").alias("s"))
    return both.join(only, "t", "left_semi").join(back, ["s", "t"], "left_anti").select("s", "a", "b", "t")


def components(arcs: DataFrame) -> DataFrame:
    """seg_id, component (least segment) over undirected links between segments."""
    return connected(arcs.select(segment_of(F.col("v")).alias("a"), segment_of(F.col("w")).alias("b"))).select(F.col("id").alias("seg_id"), F.col("root").alias("component"))


def component_classes(members: DataFrame, typed: DataFrame, arcs: DataFrame) -> DataFrame:
    """component, n (vertices), n12, n4, avg_out, kind: kept, hap or dropped, by size and composition.

    members: (seg_id, component); typed: (v, node_type). Components of four to nine vertices are haplotype chains, of
    fewer are dropped.
    """
    v = members.select("component", F.explode(F.array(F.col("seg_id") * 2, F.col("seg_id") * 2 + 1)).alias("v"))
    out = arcs.groupBy("v").agg(F.count("*").alias("n_out"))
    t = F.coalesce("node_type", F.lit(0))
    s = v.join(typed, "v", "left").join(out, "v", "left").groupBy("component")
    s = s.agg(F.count("*").alias("n"), F.count_if(t.isin(1, 2)).alias("n12"), F.count_if(t == 4).alias("n4"), F.avg(F.coalesce("n_out", F.lit(0))).alias("avg_out"))
    r12, r4 = F.col("n12") / F.col("n"), F.col("n4") / F.col("n")
    poor = (F.col("n12") < 20) | (r12 < 0.4) | ((r12 < 0.61) & (r4 >= 0.1))
    big = F.when(r4 > 0.13, "hap").when(poor, F.when(F.col("avg_out") < 1.4, "hap").when((r4 >= 0.1) & (r12 < 0.8), "hap").otherwise("kept")).otherwise("kept")
    return s.withColumn("kind", F.when(F.col("n") < 4, "dropped").when(F.col("n") < 10, "hap").otherwise(big))


def every_component_hap(members: DataFrame) -> DataFrame:
    """The rule for plants: each component is a haplotype chain."""
    return members.groupBy("component").agg((F.count("*") * 2).alias("n")).withColumn("kind", F.lit("hap"))


def overlap_between(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """pairs (v, w) with ol of the shortest arc between them, 0 where there is none."""
    first = one_arc_each(arcs).select("v", "w", "ol")
    return pairs.join(first, ["v", "w"], "left").withColumn("ol", F.coalesce("ol", F.lit(0)))


def distinct_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered pairs, the lesser first."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def mirror_chains(chains: DataFrame) -> DataFrame:
    """chains (begin, end, node) and their complements."""
    mirror = chains.select(flipped(F.col("end")).alias("begin"), flipped(F.col("begin")).alias("end"), flipped(F.col("node")).alias("node"))
    return chains.select("begin", "end", "node").unionByName(mirror).distinct()


def long_chains(chains: DataFrame, segments: DataFrame, least: int = 50_000) -> DataFrame:
    """begin, end, length, n_nodes of chains longer than least bases, over distinct segments."""
    nodes = chains.select("begin", "end", segment_of(F.col("node")).alias("seg_id")).distinct()
    return nodes.join(segments.select("seg_id", "len"), "seg_id").groupBy("begin", "end").agg(F.sum("len").alias("length"), F.count("*").alias("n_nodes")).where(F.col("length") > least)


def self_loops(chains: DataFrame) -> DataFrame:
    """Chains that begin and end in one segment."""
    return chains.where(segment_of(F.col("begin")) == segment_of(F.col("end"))).select("begin", "end").distinct()


def missing_segments(segments: DataFrame, chains: DataFrame) -> DataFrame:
    """Segments in no chain."""
    return segments.join(chains.select(segment_of(F.col("node")).alias("seg_id")).distinct(), "seg_id", "left_anti")


def dominated(paths: DataFrame) -> DataFrame:
    """paths (path_id, node) whose nodes are a proper part of another path's.

    Paths meet through shared nodes: a dominated path shares all of its nodes with the one that holds it.
    """
    size = paths.groupBy("path_id").agg(F.count("*").alias("n"))
    a = paths.select(F.col("path_id").alias("a"), "node")
    b = paths.select(F.col("path_id").alias("b"), "node")
    both = a.join(b, "node").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("m"))
    both = both.join(size.select(F.col("path_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("path_id").alias("b"), F.col("n").alias("nb")), "b")
    return both.where("m = na and nb > na").select(F.col("a").alias("path_id")).distinct()


def chain_ends_met(arcs: DataFrame, chains: DataFrame, used: DataFrame) -> DataFrame:
    """begin, end, side for each chain's first unused neighbour: 1 if an arc leads to another's begin, 2 to its end."""
    ends = chains.select(F.col("begin").alias("w"), F.lit(1).alias("side")).union(chains.select(F.col("end").alias("w"), F.lit(2).alias("side"))).distinct()
    ends = ends.join(used.select(F.col("v").alias("w")), "w", "left_anti")
    own = chains.select("begin", "end", F.explode(F.array("end", flipped(F.col("begin")))).alias("v"))
    met = own.join(arcs.select("v", "w"), "v").join(ends, "w")
    return met.groupBy("begin", "end").agg(F.min(F.struct("side", "w")).alias("m")).select("begin", "end", "m.side", "m.w")


def union_of_sets(*sets: DataFrame) -> DataFrame:
    """seg_id, n_sets: segments of any of the sets of vertices (node), such as components and haplotype chains, and how many have it."""
    marked = [x.select(segment_of(F.col("node")).alias("seg_id")).distinct() for x in sets]
    both = marked[0]
    for x in marked[1:]:
        both = both.unionByName(x)
    return both.groupBy("seg_id").agg(F.count("*").alias("n_sets"))


def neighbours(arcs: DataFrame) -> DataFrame:
    """v, after, before: sorted vertices that a vertex leads to and comes from, for a listing of a graph."""
    a = arcs.select("v", F.col("w").alias("after"), F.lit(None).cast("long").alias("before")).unionByName(arcs.select(F.col("w").alias("v"), F.lit(None).cast("long").alias("after"), F.col("v").alias("before")))
    return a.groupBy("v").agg(F.array_sort(F.collect_set("after")).alias("after"), F.array_sort(F.collect_set("before")).alias("before"))


def graph_summary(bubbles: DataFrame, haps: DataFrame, chains: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct segments in bubbles (node), haplotype chains (node) and chains (node), and those in none."""
    kinds = bubbles.select("node", F.lit("bubble").alias("kind")).union(haps.select("node", F.lit("hap"))).union(chains.select("node", F.lit("chain")))
    k = kinds.select(segment_of(F.col("node")).alias("seg_id"), "kind").distinct()
    flags = segments.select("seg_id").join(k, "seg_id", "left").groupBy("seg_id").agg(*[F.max(F.when(F.col("kind") == x, 1).otherwise(0)).alias(x) for x in ("bubble", "hap", "chain")])
    return flags.agg(*[F.sum(x).alias(f"n_{x}") for x in ("bubble", "hap", "chain")], F.count_if((F.col("bubble") + F.col("hap") + F.col("chain")) == 0).alias("n_missing"))

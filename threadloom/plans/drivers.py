"""Whole runs: reads to contacts, and an assembly graph to phased chains and paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import graph, mapping, walks
from threadloom.operators.kmers import unique_owner_index
from threadloom.plans.staging import settle
from threadloom.sources import formats, sinks


def map_to_contacts(first: DataFrame, second: DataFrame, targets: DataFrame, k: int, groups: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(contacts, statistics) of mates (read_idx, seq) that belong together by read_idx, on targets (owner, seq).

    groups (id, grp): pairs between units of different groups are left out. The index is built once, of all targets.
    """
    index = settle(unique_owner_index(targets, k))

    def mapped(reads: DataFrame) -> DataFrame:
        hits = mapping.colinear(mapping.majority_strand(mapping.anchor_hits(reads, index, k)), strict)
        return settle(mapping.best_target(mapping.target_support(hits, k)).select("read_idx", "target", "same"))

    a, b = mapped(first), mapped(second)
    pairs = mapping.zip_mates(a, b)
    groups = groups if groups is not None else first.sparkSession.createDataFrame([], "id long, grp int")
    return mapping.contacts(mapping.group_guard(pairs, groups)), mapping.run_statistics(a, b, groups)


def map_files(spark: SparkSession, targets: str, reads1: str, reads2: str, out: str, k: int = 31, groups: str | None = None, strict: bool = False) -> None:
    """A FASTA file of targets and two FASTQ files of mates to a contact table in out. Units are the places of targets by name, read from 0."""
    named = formats.read_fasta(spark, targets).select("name", "seq")
    ids = settle(formats.numbered_by(named.select("name"), "name"))
    owned = named.join(ids, "name").select(F.col("no").alias("owner"), "seq")
    mates = [formats.read_fastq(spark, x).select("read_idx", "seq") for x in (reads1, reads2)]
    table, _ = map_to_contacts(*mates, owned, k, formats.read_groups(spark, groups) if groups else None, strict)
    sinks.write_contacts(table, f"{out}/contacts")
    ids.select(F.concat_ws("\t", "no", "name").alias("value")).write.mode("overwrite").text(f"{out}/units")


@dataclass
class Phased:
    segments: DataFrame  # seg_id, name, seq, len
    arcs: DataFrame  # v, w, ol, arc_len, with those that repair adds
    bubbles: DataFrame  # as of walks.bubble_nodes
    types: DataFrame  # v, node_type: 1 bubble end, 2 within, 3 tip, 4 linear
    tips: DataFrame  # as of walks.classify_tips, without turning tips among the branches
    added: DataFrame  # component, v, w: arcs that repair adds
    members: DataFrame  # seg_id, component, after repair
    kinds: DataFrame  # component and what it is: kept, hap or dropped
    paths: DataFrame  # component, path_no, ord, v: greedy paths of haplotype components
    sequences: DataFrame  # the paths' sequences
    chains: DataFrame  # begin, end, node: both strands, with boundary vertices
    long: DataFrame  # begin, end, length, n_nodes of chains that are kept
    nodes: DataFrame  # begin, end, seg_id of kept chains
    summary: DataFrame  # one row


def _typed(arcs: DataFrame, bubbles: DataFrame) -> DataFrame:
    """v, node_type of bubbles, and 3 for tips on either strand that no bubble has."""
    inside = walks.node_types(bubbles)
    tips = graph.tips_and_knots(arcs).where("tip").select("v").join(inside, "v", "left_anti")
    return settle(inside.unionByName(tips.withColumn("node_type", F.lit(3))))


def _lengths(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """arcs with len_v and len_w."""
    size = segments.select("seg_id", "len")
    for end in ("v", "w"):
        arcs = arcs.withColumn("seg_id", F.shiftright(end, 1)).join(size.withColumnRenamed("len", f"len_{end}"), "seg_id").drop("seg_id")
    return arcs


def attach_bounds(chains: DataFrame, bubbles: DataFrame) -> DataFrame:
    """chains (begin, end, node) with the vertices that follow begin in bubbles from it, and those that precede end in bubbles to it."""
    ends = chains.select("begin", "end").distinct()
    after = bubbles.where("first").select(F.col("s").alias("begin"), F.col("v").alias("node"))
    before = bubbles.where("last").select(F.col("t").alias("end"), F.col("v").alias("node"))
    more = ends.join(after, "begin").select("begin", "end", "node").unionByName(ends.join(before, "end").select("begin", "end", "node"))
    return chains.select("begin", "end", "node").unionByName(more).distinct()


def phase(segments: DataFrame, arcs: DataFrame, least_path: int = 1_000_000, least_chain: int = 50_000, plant: bool = False) -> Phased:
    """From segments (seg_id, name, seq, len) and arcs (v, w, ol, arc_len, closed under complements) to chains and paths.

    One arc a pair; superbubbles and tips; components and their kinds; branch and turning tips and the arcs that repair
    them; bubbles of the repaired graph, linear vertices, components again; greedy paths and their sequences in haplotype
    components (with plant, in all); chains between bubble ends in kept components, with boundary vertices, on both strands,
    those longer than least_chain; counts of it all. Each stage's result is a table in the shared folder.
    """
    one = settle(graph.one_arc_each(arcs).select("v", "w", "ol", "arc_len"))
    members = settle(graph.components(one))
    first = settle(walks.bubble_nodes(one, members))
    types = _typed(one, first)

    def kinds_of(m: DataFrame, t: DataFrame, a: DataFrame) -> DataFrame:
        return settle(graph.every_component_hap(m) if plant else graph.component_classes(m, t, a))

    # tips are sought where bubbles are: in components that are kept
    kinds = kinds_of(members, types, one)
    kept = members.join(kinds.where("kind = 'kept'").select("component"), "component", "left_semi")
    tips = settle(walks.classify_tips(_lengths(one, segments), kept, types))
    turning = tips.where("kind = 'turn'").select(F.explode(F.array("v", "partner")).alias("x"))
    turning = turning.select(F.explode(F.array("x", graph.flipped(F.col("x")))).alias("v")).distinct()
    tips = settle(tips.where("kind <> 'branch'").unionByName(tips.where("kind = 'branch'").join(turning, "v", "left_anti")))
    added = settle(walks.repair_arcs(_lengths(one, segments), kept, types, tips))
    new = added.select("v", "w").distinct().join(one, ["v", "w"], "left_anti").withColumn("seg_id", F.shiftright("v", 1)).join(segments.select("seg_id", "len"), "seg_id")
    whole = settle(one.unionByName(new.select("v", "w", F.lit(0).cast("long").alias("ol"), F.col("len").alias("arc_len"))))

    # arcs to add lie within components, so these are as they were
    bubbles = settle(walks.bubble_nodes(whole, members))
    types = _typed(whole, bubbles)
    types = settle(types.unionByName(graph.linear_vertices(whole, types).withColumn("node_type", F.lit(4))))
    kinds = kinds_of(members, types, whole)
    haps = members.join(kinds.where("kind = 'hap'").select("component"), "component", "left_semi")
    kept = members.join(kinds.where("kind = 'kept'").select("component"), "component", "left_semi")
    paths = settle(walks.greedy_paths_of(walks.walk_rows(whole, haps, segments), least_path))
    joined = paths.select((F.col("component") * 2**20 + F.col("path_no")).alias("path"), "ord", "v")
    sequences = walks.join_sequences(joined, segments, whole)

    ends = settle(walks.pure_degrees(whole, kept, bubbles))
    found = walks.extract_chains(whole, kept, ends, types).select("begin", "end", "node")
    chains = settle(graph.mirror_chains(attach_bounds(found, bubbles)))
    long = settle(graph.long_chains(chains, segments, least_chain))
    nodes = chains.join(long.select("begin", "end"), ["begin", "end"], "left_semi").select("begin", "end", graph.segment_of(F.col("node")).alias("seg_id")).distinct()
    hap_nodes = haps.select((F.col("seg_id") * 2).alias("node"))
    summary = graph.graph_summary(nodes.select((F.col("seg_id") * 2).alias("node")), hap_nodes, chains.select("node"), segments)
    return Phased(segments, whole, bubbles, types, tips, added, members, kinds, paths, sequences, chains, long, nodes, summary)


def phase_files(spark: SparkSession, gfa: str, out: str, plant: bool = False, **limits: int) -> Phased:
    """A GFA file to chains, paths, sequences and graphs in the folder out."""
    p = phase(*formats.read_gfa(spark, gfa), plant=plant, **limits)
    kept = p.long.select("begin", "end")
    sinks.write_chain_graph(kept, p.segments, f"{out}/chains")
    sinks.write_main_graph(kept, p.segments, f"{out}/main_graph")
    sinks.write_lengthless_graph(p.arcs, p.segments, f"{out}/full_graph")
    p.nodes.join(p.segments.select("seg_id", "name"), "seg_id").select(F.concat_ws("\t", "begin", "end", "name").alias("value")).write.mode("overwrite").text(f"{out}/nodes")
    p.sequences.select(F.concat(F.lit(">"), "path").alias("head"), "seq").select(F.concat_ws("\n", "head", "seq").alias("value")).write.mode("overwrite").text(f"{out}/paths")
    p.summary.write.mode("overwrite").json(f"{out}/summary")
    return p

"""Writers. Each replaces its own dataset and never another folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, emptyValue="", nullValue="")


def contact_lines(contacts: DataFrame) -> DataFrame:
    """i, j, fwd, bwd with i > j and a count."""
    c = contacts.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "fwd", "bwd").where("i > j and fwd + bwd > 0")
    return c.groupBy("i", "j").agg(F.sum("fwd").alias("fwd"), F.sum("bwd").alias("bwd"))


def write_contacts(contacts: DataFrame, path: str) -> None:
    _tsv(contact_lines(contacts), path, header=False)


def write_kmer_table(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)


def gfa_chain_lines(chains: DataFrame, segments: DataFrame) -> DataFrame:
    """value: S lines for the distinct ends of chains (begin, end), then L lines between them, without overlap."""
    ends = chains.select(F.explode(F.array(F.shiftright("begin", 1), F.shiftright("end", 1))).alias("seg_id")).distinct().join(segments, "seg_id")
    s = ends.select(F.lit(0).alias("k"), F.concat_ws("\t", F.lit("S"), "name", F.lit("*"), F.concat(F.lit("LN:i:"), "len")).alias("value"))
    sign = lambda v: F.when(F.col(v) % 2 == 0, "+").otherwise("-")
    b, e = (segments.select(F.col("seg_id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name")) for x in ("b", "e"))
    links = chains.select("begin", "end").distinct().withColumn("b_id", F.shiftright("begin", 1)).withColumn("e_id", F.shiftright("end", 1)).join(b, "b_id").join(e, "e_id")
    lines = links.select(F.lit(1).alias("k"), F.concat_ws("\t", F.lit("L"), "b_name", sign("begin"), "e_name", sign("end"), F.lit("0M")).alias("value"))
    return s.union(lines).orderBy("k", "value").select("value")


def write_chain_graph(chains: DataFrame, segments: DataFrame, path: str) -> None:
    gfa_chain_lines(chains, segments).write.mode("overwrite").text(path)


def _sign(v: str) -> Column:
    return F.when(F.col(v) % 2 == 0, "+").otherwise("-")


def _named_links(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """value: L lines without overlap between the vertices v and w."""
    v, w = (segments.select(F.col("seg_id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name")) for x in "vw")
    named = pairs.withColumn("v_id", F.shiftright("v", 1)).withColumn("w_id", F.shiftright("w", 1)).join(v, "v_id").join(w, "w_id")
    return named.select(F.concat_ws("\t", F.lit("L"), "v_name", _sign("v"), "w_name", _sign("w"), F.lit("0M")).alias("value"))


def main_graph_lines(chains: DataFrame, segments: DataFrame) -> DataFrame:
    """value: S lines without length for segments at which chains begin forwards, and an L line for each chain (begin, end)."""
    ends = chains.select("begin", "end").distinct()
    begins = ends.where("begin % 2 = 0").select(F.shiftright("begin", 1).alias("seg_id")).distinct().join(segments.select("seg_id", "name"), "seg_id")
    s = begins.select(F.concat_ws("\t", F.lit("S"), "name", F.lit("*")).alias("value"))
    return s.union(_named_links(ends.select(F.col("begin").alias("v"), F.col("end").alias("w")), segments))


def lengthless_graph_lines(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """value: S lines without length for all segments, and an L line for each arc."""
    return segments.select(F.concat_ws("\t", F.lit("S"), "name", F.lit("*")).alias("value")).union(_named_links(arcs.select("v", "w"), segments))


def write_main_graph(chains: DataFrame, segments: DataFrame, path: str) -> None:
    main_graph_lines(chains, segments).write.mode("overwrite").text(path)


def write_lengthless_graph(arcs: DataFrame, segments: DataFrame, path: str) -> None:
    lengthless_graph_lines(arcs, segments).write.mode("overwrite").text(path)


def node_colours(chains: DataFrame, segments: DataFrame) -> DataFrame:
    """node, colour of the segments at which chains end, by id."""
    ends = chains.select(F.explode(F.array(F.shiftright("begin", 1), F.shiftright("end", 1))).alias("seg_id")).distinct()
    return ends.join(segments.select("seg_id", "name"), "seg_id").orderBy("seg_id").select(F.col("name").alias("node"), F.lit("red").alias("colour"))


def fasta_lines(df: DataFrame, name: str = "name", seq: str = "seq", width: int | None = None) -> DataFrame:
    text: Column = F.col(seq) if width is None else F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), text).alias("value"))


def path_lines(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """value: `chain: seg± seg± …` from paths (path, ord, v)."""
    n = paths.withColumn("seg_id", F.shiftright("v", 1)).join(segments.select("seg_id", "name"), "seg_id")
    n = n.withColumn("s", F.concat("name", F.when(F.col("v") % 2 == 0, "+").otherwise("-")))
    g = n.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"]), " ").alias("t"))
    return g.select(F.concat(F.col("path").cast("string"), F.lit(": "), "t").alias("value"))


def write_paths(paths: DataFrame, sequences: DataFrame, segments: DataFrame, folder: str) -> None:
    """Sequences as FASTA and paths as text, with segments that no path has as sequences of their own."""
    rest = segments.join(paths.select(F.shiftright("v", 1).alias("seg_id")).distinct(), "seg_id", "left_anti").where("seq is not null").select("name", "seq")
    named = sequences.select(F.col("path").cast("string").alias("name"), "seq").unionByName(rest)
    fasta_lines(named).write.mode("overwrite").text(f"{folder}/scaffold.fa")
    path_lines(paths, segments).write.mode("overwrite").text(f"{folder}/scaffold_path.txt")


def alignment_rows(best: DataFrame, reads: DataFrame, targets: DataFrame) -> DataFrame:
    """PAF columns of mapped reads, with made-up matches and mapping quality by anchors."""
    from threadloom.functions.scalars import mapping_quality, synthetic_matches

    q = reads.select("read_idx", F.length("seq").alias("Q_Len"))
    t = targets.select(F.col("owner").alias("target"), F.length("seq").alias("T_Len"))
    b = best.join(q, "read_idx").join(t, "target")
    spans = F.col("qend") - F.col("qstart"), F.col("tend") - F.col("tstart")
    return b.select(
        F.col("read_idx").alias("Q_Name"), "Q_Len", F.col("qstart").alias("Q_Start"), F.col("qend").alias("Q_End"), F.when(F.col("same"), "+").otherwise("-").alias("Strand"), F.col("target").alias("T_Name"), "T_Len",
        F.col("tstart").alias("T_Start"), F.col("tend").alias("T_End"), synthetic_matches(*spans).alias("Matches"), F.greatest(*spans).alias("Block_Len"), mapping_quality(F.col("hits")).alias("MapQ"),
    )


def write_alignments(rows: DataFrame, path: str) -> None:
    _tsv(rows, path, header=False)


def intersect_graph(alignments: DataFrame, segments: DataFrame) -> DataFrame:
    """Alignments whose target's number is a segment's."""
    from threadloom.functions.scalars import name_number

    numbers = segments.select(name_number(F.col("name")).alias("_n")).where("_n is not null").distinct()
    return alignments.withColumn("_n", name_number(F.col("T_Name"))).join(numbers, "_n", "left_semi").drop("_n")


def write_evaluation(scores: DataFrame, detail: DataFrame, summary: DataFrame, assessment: DataFrame, folder: str) -> None:
    """error.tsv (worst first), detail.tsv, mapping_summary.tsv and assess.tsv."""
    _tsv(scores.orderBy(F.desc("Total_Error_Sum"), "Contig"), f"{folder}/error.tsv")
    _tsv(detail, f"{folder}/detail.tsv")
    _tsv(summary, f"{folder}/mapping_summary.tsv")
    _tsv(assessment, f"{folder}/assess.tsv")


def write_rescued(genes: DataFrame, path: str) -> None:
    _tsv(genes.orderBy("Chrom", "Gene_Start"), path)


def paired_fastq_lines(pairs: DataFrame, mate: int) -> DataFrame:
    """value: one record a pair (read, pair_no, seq1, seq2), with a quality of I throughout."""
    seq = F.col(f"seq{mate}")
    return pairs.select(F.concat(F.lit("@"), "read", F.lit("_"), "pair_no", F.lit(f" {mate}\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq))).alias("value"))


def write_paired_fastq(pairs: DataFrame, path1: str, path2: str) -> None:
    for mate, path in ((1, path1), (2, path2)):
        paired_fastq_lines(pairs, mate).write.mode("overwrite").text(path)

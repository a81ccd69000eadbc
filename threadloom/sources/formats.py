"""Readers of graph, sequence, alignment, annotation and table formats. Schemas are fixed; gz files are read as such."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import cigar_lengths

PAF = "Q_Name string, Q_Len long, Q_Start long, Q_End long, Strand string, T_Name string, T_Len long, T_Start long, T_End long, Matches long, Block_Len long, MapQ int"


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with a number that rises in a file's order."""
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def gfa_lines(spark: SparkSession, path: str) -> DataFrame:
    """S and L lines of a graph file: line_no, kind, f (fields). Others and lines under three letters are skipped."""
    t = _numbered(spark.read.text(path)).where((F.length("value") >= 3) & (F.substring("value", 2, 1) == "\t") & F.substring("value", 1, 1).isin("S", "L"))
    return t.select("line_no", F.substring("value", 1, 1).alias("kind"), F.split("value", "\t").alias("f"))


def gfa_segments(lines: DataFrame, read_length_tag: bool = True) -> DataFrame:
    """name, seq (null for *), len: of the sequence, or where it is missing of the LN tag (0 without reading it)."""
    s = lines.where("kind = 'S' and size(f) >= 3")
    told = F.coalesce(F.substring(F.try_element_at(F.filter("f", lambda x: x.startswith("LN:i:")), F.lit(1)), 6, 20).try_cast("long"), F.lit(0)) if read_length_tag else F.lit(0)
    seq = F.when(F.col("f")[2] != "*", F.col("f")[2])
    return s.select("line_no", F.col("f")[1].alias("name"), seq.alias("seq"), F.coalesce(F.length(seq).cast("long"), told.cast("long")).alias("len"))


def gfa_links(lines: DataFrame) -> DataFrame:
    """v_name, v_orient, w_name, w_orient (0, 1; -2 if neither + nor -), ov, ow: overlaps from a:b or a CIGAR."""
    f = F.col("f")
    orient = lambda x: F.when(x == "+", 0).when(x == "-", 1).otherwise(-2)
    both = f[5].contains(":")
    on_v, on_w = cigar_lengths(f[5])
    part = lambda i: F.split(f[5], ":")[i].try_cast("long")
    return lines.where("kind = 'L' and size(f) >= 6").select(
        "line_no", f[1].alias("v_name"), orient(f[2]).alias("v_orient"), f[3].alias("w_name"), orient(f[4]).alias("w_orient"),
        F.coalesce(F.when(both, part(0)).otherwise(on_v), F.lit(0)).alias("ov"), F.coalesce(F.when(both, part(1)).otherwise(on_w), F.lit(0)).alias("ow"),
    )


def numbered_by(df: DataFrame, name: str) -> DataFrame:
    """name, no: distinct values of a column in their order, from 0; windows are over counts of ranges by first letters, then within each."""
    one = df.select(name).distinct().withColumn("part", F.substring(name, 1, 6))
    before = one.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return one.join(before, "part").select(name, (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1).alias("no"))


def intern_segments(segments: DataFrame, links: DataFrame) -> DataFrame:
    """seg_id in order of first sight on S or L lines, name, seq, len (0 for names that only links have).

    Numbers follow line order, made by ranges: a window over counts of ranges, then one within each range.
    """
    seen = segments.select("name", F.struct("line_no", F.lit(0).alias("slot")).alias("at"))
    for slot, name in ((1, "v_name"), (2, "w_name")):
        seen = seen.union(links.select(F.col(name).alias("name"), F.struct("line_no", F.lit(slot).alias("slot")).alias("at")))
    first = seen.groupBy("name").agg(F.min("at").alias("at")).withColumn("range", F.floor(F.col("at.line_no") / 100_000))
    before = first.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    ids = first.join(before, "range").select("name", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("at")) - 1).alias("seg_id"))
    one = segments.groupBy("name").agg(F.min_by(F.struct("seq", "len"), "line_no").alias("s"))
    return ids.join(one, "name", "left").select("seg_id", "name", "s.seq", F.coalesce("s.len", F.lit(0)).alias("len"))


def link_vertices(links: DataFrame, segments: DataFrame) -> DataFrame:
    """v, w, ov, ow; links with a bad orientation go."""
    v, w = (segments.select(F.col("name").alias(f"{x}_name"), F.col("seg_id").alias(f"{x}_id")) for x in "vw")
    good = links.where("v_orient >= 0 and w_orient >= 0").join(v, "v_name").join(w, "w_name")
    return good.select((F.col("v_id") * 2 + F.col("v_orient")).alias("v"), (F.col("w_id") * 2 + F.col("w_orient")).alias("w"), "ov", "ow")


def read_gfa(spark: SparkSession, path: str, read_length_tag: bool = True) -> tuple[DataFrame, DataFrame]:
    """(segments, arcs), closed under complements and with arc lengths."""
    from threadloom.operators.graph import finalize

    lines = gfa_lines(spark, path)
    links = gfa_links(lines)
    segments = intern_segments(gfa_segments(lines, read_length_tag), links)
    return segments, finalize(link_vertices(links, segments), segments)


def parse_sequences(text: str) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, seq, qual) of FASTA or FASTQ text, on one line or many. Stops at a truncated or mismatched quality."""
    lines, i = text.split("\n"), 0
    while i < len(lines):
        head = lines[i].rstrip("\r")
        i += 1
        if not head or head[0] not in ">@":
            continue
        name, _, comment = head[1:].partition(" ")
        name, _, tabbed = name.partition("\t")
        seq: list[str] = []
        while i < len(lines) and lines[i][:1] not in (">", "@", "+"):
            seq.append(lines[i].strip())
            i += 1
        whole, qual = "".join(seq), None
        if i < len(lines) and lines[i][:1] == "+":
            i, got = i + 1, ""
            while i < len(lines) and len(got) < len(whole):
                got += lines[i].rstrip("\r")
                i += 1
            if len(got) != len(whole):
                return
            qual = got
        yield name, (comment or tabbed) or None, whole, qual


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """file, read_idx (place in the file), name, comment, seq, qual of FASTA and FASTQ files, records on any number of lines.

    A record's bounds depend on what lies before it, so a file is one row, of 2 GB at most. read_fastq and read_fasta read
    files of any size in parallel.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                rows = [(file, i, *r) for i, r in enumerate(parse_sequences(text))]
                yield pd.DataFrame(rows, columns=["file", "read_idx", "name", "comment", "seq", "qual"])

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.mapInPandas(run, "file string, read_idx long, name string, comment string, seq string, qual string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq of FASTA files, split where a line starts with ">" and so read in parallel; order is not kept."""
    t = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\n\r]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return t.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.regexp_extract(head, r"^\S*\s+(.*)$", 1), F.lit("")).alias("comment"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, read_idx, name, comment, seq, qual of FASTQ files with four lines a record, as sequencers write them; files are read in splits.

    A first pass counts the lines of each split, which gives each line its place in its file; four lines then meet by
    shuffle. Splits depend on files and settings only, so both passes see the same. Records whose quality is not as long
    as their sequence, and incomplete ones, go.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), "value")
    splits = lines.groupBy("file", "block").agg(F.min("no").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    splits = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    return fastq_records(lines.join(splits, ["file", "block"]).withColumn("at", F.col("no") + F.col("shift")))


def fastq_records(placed: DataFrame) -> DataFrame:
    """file, read_idx, name, comment, seq, qual from lines (file, at: place from 0, value), four a record."""
    part = lambda i: F.max(F.when(F.col("at") % 4 == i, F.rtrim(F.col("value"), F.lit("\r"))))
    t = placed.groupBy("file", F.expr("at div 4").alias("read_idx")).agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    head = F.substring("head", 2, F.length("head"))
    return t.where(F.col("head").startswith("@") & (F.length("qual") == F.length("seq"))).select(
        "file", "read_idx", F.regexp_extract(head, r"^([^ \t]*)", 1).alias("name"), F.nullif(F.regexp_extract(head, r"^[^ \t]*[ \t](.*)$", 1), F.lit("")).alias("comment"), "seq", "qual"
    )


def build_reads(reads: DataFrame, k: int) -> DataFrame:
    """Sequences of k bases or more, which keep their place in the file as owner."""
    return reads.where(F.length("seq") >= k).select(F.col("read_idx").alias("owner"), "seq")


def class_quality_reads(reads: DataFrame) -> DataFrame:
    """Reads whose quality is as long as their sequence."""
    return reads.where(F.length("qual") == F.length("seq"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return paf_rows(spark.read.text(path))


def paf_rows(lines: DataFrame) -> DataFrame:
    """Alignments of twelve columns (ten at least); shorter rows go, further columns are ignored."""
    f = F.split("value", "\t")
    names = [c.strip().split(" ") for c in PAF.split(",")]
    return lines.where(F.size(f) >= 10).select(*[F.get(f, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def read_contacts(spark: SparkSession, path: str, legacy_swap: bool = False) -> DataFrame:
    return contact_rows(_numbered(spark.read.text(path)), legacy_swap)


def contact_rows(lines: DataFrame, legacy_swap: bool = False) -> DataFrame:
    """i, j, fwd, bwd in both directions; of lines (line_no, value) for one pair the last counts. legacy_swap takes the third column as bwd."""
    f = F.split(F.trim("value"), r"\s+")
    t = lines.where(F.size(f) >= 4).select("line_no", *[F.get(f, F.lit(k)).try_cast("long").alias(c) for k, c in enumerate(("i", "j", "fwd", "bwd"))])
    t = t.where("i is not null and j is not null")
    if legacy_swap:
        t = t.select("line_no", "i", "j", F.col("bwd").alias("fwd"), F.col("fwd").alias("bwd"))
    both = t.unionByName(t.select("line_no", F.col("j").alias("i"), F.col("i").alias("j"), "fwd", "bwd"))
    return both.groupBy("i", "j").agg(F.max_by(F.struct("fwd", "bwd"), "line_no").alias("x")).select("i", "j", "x.fwd", "x.bwd")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """id, grp from lines id,type; a header with the word node and bad lines go, the last of an id counts."""
    f = F.split("value", ",")
    t = _numbered(spark.read.text(path)).where(~F.col("value").rlike("[nN]ode")).select("line_no", F.trim(F.get(f, F.lit(0))).try_cast("long").alias("id"), F.trim(F.get(f, F.lit(1))).try_cast("int").alias("grp"))
    return t.where("id is not null and grp is not null").groupBy("id").agg(F.max_by("grp", "line_no").alias("grp"))


def named_bubble_contigs(lines: DataFrame) -> DataFrame:
    """pair_no, hap1, hap2 from lines (line_no from 0 without gaps, value): consecutive lines that are not empty; an odd last one goes."""
    full = lines.where(F.trim("value") != "").withColumn("range", F.floor(F.col("line_no") / 100_000))
    before = full.groupBy("range").agg(F.count("*").alias("c")).select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))
    full = full.join(before, "range").withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("line_no")) - 1)
    names = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")
    g = full.groupBy(F.floor(F.col("n") / 2).alias("pair_no")).agg(F.count("*").alias("c"), F.min_by(names, "n").alias("hap1"), F.max_by(names, "n").alias("hap2"))
    return g.where("c = 2").drop("c")


def read_named_bubble_contigs(spark: SparkSession, path: str) -> DataFrame:
    return named_bubble_contigs(_numbered(spark.read.text(path)))


def genome_info(lines: DataFrame) -> DataFrame:
    """T_Name, ref_len from lines `name (total length: N bp`."""
    p = r"(\S+)\s+\(total length:\s+(\d+)\s+bp"
    return lines.select(F.regexp_extract("value", p, 1).alias("T_Name"), F.regexp_extract("value", p, 2).try_cast("long").alias("ref_len")).where("T_Name <> ''")


def gff_genes(lines: DataFrame) -> DataFrame:
    """Chrom, Gene_Start, Gene_End, Strand, Gene_Name of gene rows; the last of Name= and gene_name=, else the first ID=, else Unknown."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 9)).select(f.alias("f")).where("f[2] = 'gene'")
    attrs = F.transform(F.split(F.col("f")[8], ";"), lambda x: F.trim(x))
    clean = lambda x, n: F.regexp_replace(F.substring(x, F.lit(n), F.length(x)), '^"|"$', "")
    named = F.transform(F.filter(attrs, lambda x: x.startswith("Name=") | x.startswith("gene_name=")), lambda x: F.when(x.startswith("Name="), clean(x, 6)).otherwise(clean(x, 11)))
    ids = F.transform(F.filter(attrs, lambda x: x.startswith("ID=")), lambda x: clean(x, 4))
    name = F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(ids, F.lit(1)), F.lit("Unknown"))
    return rows.select(F.col("f")[0].alias("Chrom"), F.col("f")[3].cast("long").alias("Gene_Start"), F.col("f")[4].cast("long").alias("Gene_End"), F.col("f")[6].alias("Strand"), name.alias("Gene_Name"))


def read_detail(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header line."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def fragments(lines: DataFrame) -> DataFrame:
    """read, ord, start, end (one less than written) from lines name:start:end."""
    f = F.split("value", ":")
    return lines.where(F.size(f) == 3).select(f[0].alias("read"), F.col("line_no").alias("ord"), f[1].try_cast("long").alias("start"), (f[2].try_cast("long") - 1).alias("end"))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return fragments(_numbered(spark.read.text(path)))


def read_kmer_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by write_kmer_table."""
    return spark.read.parquet(path)

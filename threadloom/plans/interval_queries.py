"""Queries on intervals, tiles, genes, fragments and the formats of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import intervals as op
from threadloom.operators import metrics, sketch
from threadloom.plans.registry import query
from threadloom.plans.relations import SQL_BLOCKS, SQL_BLOCKS2, SQL_GENES, SQL_INTERVALS, SQL_PLACED_TILES, SQL_TARGETS, SQL_TILES, blocks, blocks2, genes, intervals, table, targets, tiles
from threadloom.sources import formats, sinks


@query("F14_overlap_length", "grp:l start:l stop:l shared:l", f"with {SQL_INTERVALS} select grp, start, \"end\" as stop, coalesce(greatest(0, least(lag(\"end\") over w, \"end\") - greatest(lag(start) over w, start)), 0) as shared from intervals window w as (partition by grp order by start, \"end\")")
def overlaps(spark: SparkSession, d: str) -> DataFrame:
    return op.overlap_pairs(intervals(spark, d)).withColumnRenamed("end", "stop")


@query("F15_W4_merge_intervals", "grp:l start:l stop:l n:l", f"with {SQL_INTERVALS}, m as (select *, case when start > max(\"end\") over (partition by grp order by start, \"end\" rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from intervals), i as (select *, sum(new) over (partition by grp order by start, \"end\" rows unbounded preceding) as island from m) select grp, min(start) as start, max(\"end\") as stop, count(*) as n from i group by grp, island")
def merged(spark: SparkSession, d: str) -> DataFrame:
    return op.merge_intervals(intervals(spark, d)).withColumnRenamed("end", "stop")


@query("T1_P14_tile", "Q_Name:l T_Name:s Q_Start:l Q_End:l Block_Len:l")
def tiled(spark: SparkSession, d: str) -> DataFrame:
    return op.tile(tiles(spark, d), least_block=5)


_OUT = '"Gene_Name", "Chrom", "Gene_Start"'
_IN = 'exists (select 1 from {0} b where b."Chrom" = g."Chrom" and b."T_Start" <= g."Gene_Start" and b."T_End" >= g."Gene_End")'
_NEAR = 'exists (select 1 from (select "Chrom", "T_Start" as edge from blocks union all select "Chrom", "T_End" from blocks) b where b."Chrom" = g."Chrom" and edge between g."Gene_Start" - 500 and g."Gene_End" + 500)'


@query("J10_contained", "Gene_Name:l Chrom:l Gene_Start:l", f"with {SQL_BLOCKS}, {SQL_GENES} select {_OUT} from genes g where {_IN.format('blocks')}")
def contained(spark: SparkSession, d: str) -> DataFrame:
    return op.contained(genes(spark, d), blocks(spark, d))


@query("J10_not_contained", "Gene_Name:l Chrom:l Gene_Start:l", f"with {SQL_BLOCKS}, {SQL_GENES} select {_OUT} from genes g where not {_IN.format('blocks')}")
def not_contained(spark: SparkSession, d: str) -> DataFrame:
    return op.contained(genes(spark, d), blocks(spark, d), "left_anti")


@query("J11_near_break", "Gene_Name:l Chrom:l Gene_Start:l", f"with {SQL_BLOCKS}, {SQL_GENES} select {_OUT} from genes g where {_NEAR}")
def near(spark: SparkSession, d: str) -> DataFrame:
    return op.near_break(genes(spark, d), blocks(spark, d))


@query("J12_K10_rescued_genes", "Gene_Name:l Chrom:l Gene_Start:l Gene_Length:l", f"with {SQL_BLOCKS}, {SQL_BLOCKS2}, {SQL_GENES} select {_OUT}, \"Gene_End\" - \"Gene_Start\" as \"Gene_Length\" from genes g where not {_IN.format('blocks')} and {_NEAR} and {_IN.format('blocks2')}")
def rescued(spark: SparkSession, d: str) -> DataFrame:
    return op.rescued_genes(genes(spark, d), blocks(spark, d), blocks2(spark, d))


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    start = F.col("l_linenumber") * 10
    return l.select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("ord"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))


_FRAGMENTS = 'f as (select l_orderkey as read, l_linenumber as ord, l_linenumber * 10 as start, l_linenumber * 10 + l_quantity::int as "end" from lineitem)'


@query("J13_K11_fragment_pairs", "read:l pair_no:l start1:l end1:l start2:l end2:l", f"with {_FRAGMENTS} select a.read, row_number() over (partition by a.read order by a.ord, b.ord) as pair_no, a.start as start1, a.\"end\" as end1, b.start as start2, b.\"end\" as end2 from f a join f b on a.read = b.read and a.ord < b.ord")
def fragment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return op.fragment_pairs(_fragments(spark, d))


@query("J14_fragment_sequences", "read:l ord:l seq:s", f"with {_FRAGMENTS}, {SQL_TARGETS} select read, ord, substr(seq, start + 1, \"end\" - start) as seq from f join targets on owner = read")
def fragment_sequences(spark: SparkSession, d: str) -> DataFrame:
    return op.fragment_sequences(_fragments(spark, d), targets(spark, d).withColumnRenamed("owner", "read"))


_PURITY = (
    f'with {SQL_TILES}, b as (select "Q_Name", base, sum("Block_Len") as n from tiles group by 1, 2), c as (select "Q_Name", 1 - sum(n::double * n) / (sum(n)::double * sum(n)) as cgi, arg_min(base, lpad((100000000 - n)::varchar, 12, \'0\') || base) as primary_base, max(n) as primary_len, sum(n) as total_len from b group by 1), '
    'h as (select "Q_Name", 2 * (1 - (m * m + p * p) / ((m + p)::double * (m + p))) as hgi from (select "Q_Name", sum("Block_Len") filter (hap = \'MAT\') as m, sum("Block_Len") filter (hap = \'PAT\') as p from tiles where hap <> \'UNK\' group by 1) where m is not null and p is not null), '
    'purity as (select "Q_Name", primary_base, primary_len, total_len, round(cgi, 9) as "CGI", round(coalesce(hgi, 0), 9) as "HGI" from c left join h using ("Q_Name")) '
)


def _purity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.contig_purity(tiles(spark, d)).withColumn("CGI", F.round("CGI", 9)).withColumn("HGI", F.round("HGI", 9))


@query("A21_contig_purity", "Q_Name:l primary_base:s primary_len:l total_len:l CGI:d HGI:d", _PURITY + "select * from purity")
def purity(spark: SparkSession, d: str) -> DataFrame:
    return _purity(spark, d)


@query("A23_K9_weighted_means", "CGI:d HGI:d", _PURITY + 'select round(sum("CGI" * total_len) / sum(total_len), 7) as "CGI", round(sum("HGI" * total_len) / sum(total_len), 7) as "HGI" from purity')
def means(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weighted_means(_purity(spark, d), "total_len", ["CGI", "HGI"]).select(F.round("CGI", 7).alias("CGI"), F.round("HGI", 7).alias("HGI"))


@query("A24_P15_mapping_summary", "Q_Name:l T_Name:s mapped:l fraction:d is_primary:b", _PURITY + ", r as (select \"T_Name\", sum(\"Block_Len\") + 1000 as ref_len from tiles where \"T_Name\" like '%NAL' group by 1) select t.\"Q_Name\", t.\"T_Name\", sum(\"Block_Len\") as mapped, round(sum(\"Block_Len\") / coalesce(any_value(ref_len), 1)::double, 9) as fraction, string_split(t.\"T_Name\", '_')[1] = any_value(primary_base) as is_primary from tiles t left join r using (\"T_Name\") join purity using (\"Q_Name\") group by 1, 2")
def mapping_summary(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d)
    r = t.where("T_Name like '%NAL'").groupBy("T_Name").agg((F.sum("Block_Len") + 1000).alias("ref_len"))
    return metrics.mapping_summary(t, r, _purity(spark, d)).withColumn("fraction", F.round("fraction", 9))


#: Stretches between edges belong to the first row over them, so a row's duplicate part is what belongs to rows before it.
_REARRANGED = f"""with {SQL_PLACED_TILES},
base as (select "Q_Name", arg_min(base, (-n, base)) as base from (select "Q_Name", base, sum("Block_Len") as n from tiles group by all) group by 1),
r as (select *, row_number() over (partition by "Q_Name" order by "Q_Start", "T_Start", "T_End", strand, "Block_Len") as rn from tiles semi join base using ("Q_Name", base)),
main as (select "Q_Name", arg_min(strand, (-n, strand)) as main from (select "Q_Name", strand, sum("Block_Len") as n from r group by all) group by 1),
edges as (select "Q_Name", "T_Start" as x from r union select "Q_Name", "T_End" from r),
stretches as (select * from (select "Q_Name", x as a, lead(x) over (partition by "Q_Name" order by x) as b from edges) where b is not null),
first as (select s."Q_Name", a, b, min(rn) as rn from stretches s join r on r."Q_Name" = s."Q_Name" and r."T_Start" <= a and r."T_End" >= b group by all),
twice as (select r."Q_Name", r.rn, sum(b - a) as n from r join first f on f."Q_Name" = r."Q_Name" and r."T_Start" <= a and r."T_End" >= b and f.rn < r.rn group by all),
d as (select r.*, main, "T_End" - "T_Start" as span, "Block_Len" * least(1.0::double, case when "T_End" > "T_Start" then coalesce(n, 0) / ("T_End" - "T_Start")::double else 0 end) as dup
  from r join main using ("Q_Name") left join twice using ("Q_Name", rn)),
g as (select *, case when strand = main then case when main = '+' then "T_Start" - lag("T_End") over w else lag("T_Start") over w - "T_End" end end as gap from d window w as (partition by "Q_Name", strand order by rn)),
k as (select "Q_Name", "Block_Len" - dup as rest, dup, strand = main as is_on, coalesce(gap < -0.1::double * span or gap > 1000000, false) as moved from g),
t as (select "Q_Name", sum(dup) as dup, sum(case when not is_on then rest else 0 end) as inv, sum(case when is_on and moved then rest else 0 end) as rel, sum(case when is_on and not moved then rest else 0 end) as correct from k group by 1),
n as (select *, case when dup + inv + rel + correct > 0 then dup + inv + rel + correct else 1 end as whole from t)
select "Q_Name", round(dup / whole, 9) as dup, round(inv / whole, 9) as inv, round(rel / whole, 9) as rel, round(correct / whole, 9) as correct, round((0.6::double * dup + 0.3::double * inv + 0.1::double * rel) / whole, 9) as "IGI" from n"""


@query("A22_W5_rearrangements", "Q_Name:l dup:d inv:d rel:d correct:d IGI:d", _REARRANGED)
def rearranged(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d).join(_purity(spark, d).select("Q_Name", F.col("primary_base").alias("base")), ["Q_Name", "base"], "left_semi")
    return metrics.rearrangements(t).select("Q_Name", *[F.round(c, 9).alias(c) for c in ("dup", "inv", "rel", "correct", "IGI")])


@query("W6_J17_seed_blocks", "read:l ref:l fwd:b qstart:l qend:l tstart:l tend:l n:l", "with s as (select l_suppkey as read, l_orderkey as qpos, l_linenumber % 2 as ref, case when l_returnflag <> 'R' then l_orderkey + l_linenumber else 10000000 - l_orderkey end as tpos, l_returnflag <> 'R' as fwd from lineitem), d as (select *, case when fwd then tpos - qpos else tpos + qpos end as d from s), b as (select *, case when lag(ref) over w = ref and lag(fwd) over w = fwd and abs(d - lag(d) over w) <= 50 then 0 else 1 end as new from d window w as (partition by read order by qpos, ref, tpos)), g as (select *, sum(new) over (partition by read order by qpos, ref, tpos rows unbounded preceding) as block from b) select read, any_value(ref) as ref, any_value(fwd) as fwd, min(qpos) as qstart, max(qpos) as qend, min(tpos) as tstart, max(tpos) as tend, count(*) as n from g group by read, block having count(*) >= 3")
def seed_blocks(spark: SparkSession, d: str) -> DataFrame:
    fwd = F.col("l_returnflag") != "R"
    s = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("read"), F.col("l_orderkey").alias("qpos"), (F.col("l_linenumber") % 2).alias("ref"),
        F.when(fwd, F.col("l_orderkey") + F.col("l_linenumber")).otherwise(10_000_000 - F.col("l_orderkey")).alias("tpos"), fwd.alias("fwd"),
    )
    return sketch.seed_blocks(s)


@query("S13_named_bubble_contigs", "pair_no:l hap1:s hap2:s", "with n as (select row_number() over (order by n_nationkey) - 1 as i, n_name || '|' || n_nationkey as v from nation) select i // 2 as pair_no, arg_min(v, i) as hap1, arg_max(v, i) as hap2 from n group by 1 having count(*) = 2")
def named_contigs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("line_no"), F.concat("n_name", F.lit(", ,"), "n_nationkey").alias("value"))
    c = formats.named_bubble_contigs(lines)
    return c.select("pair_no", F.array_join("hap1", "|").alias("hap1"), F.array_join("hap2", "|").alias("hap2"))


@query("S14_genome_info", "T_Name:s ref_len:l", "select 'chr' || p_partkey as \"T_Name\", p_size as ref_len from part")
def info(spark: SparkSession, d: str) -> DataFrame:
    return formats.genome_info(table(spark, d, "part").select(F.concat(F.lit("x chr"), "p_partkey", F.lit(" (total length: "), "p_size", F.lit(" bp)")).alias("value")))


@query("S15_gff_genes", "Chrom:s Gene_Start:l Gene_End:l Strand:s Gene_Name:s", "select 'c' || c_nationkey as \"Chrom\", c_custkey as \"Gene_Start\", c_custkey + 10 as \"Gene_End\", '+' as \"Strand\", case c_custkey % 3 when 0 then 'n' || c_custkey when 1 then 'i' || c_custkey else 'Unknown' end as \"Gene_Name\" from customer where c_custkey % 4 > 0")
def gff(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 4 > 0, "gene").otherwise("exon")
    attrs = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ID=i"), "c_custkey", F.lit(";Name=n"), "c_custkey")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("ID=i"), "c_custkey")).otherwise("note=x")
    line = F.concat_ws("\t", F.concat(F.lit("c"), "c_nationkey"), F.lit("src"), kind, "c_custkey", (F.col("c_custkey") + 10).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    return formats.gff_genes(table(spark, d, "customer").select(line.alias("value")))


@query("S17_fragments", "read:s start:l end_:l", "select 'r' || l_orderkey as read, l_linenumber * 10 as start, l_linenumber * 10 + l_quantity::int - 1 as end_ from lineitem")
def fragment_lines(spark: SparkSession, d: str) -> DataFrame:
    f = _fragments(spark, d)
    return formats.fragments(f.select(F.concat(F.lit("r"), "read", F.lit(":"), "start", F.lit(":"), "end").alias("value"), F.lit(0).alias("line_no"))).withColumnRenamed("end", "end_")


@query("K11_paired_fastq_lines", "value:s", f"with {_FRAGMENTS}, {SQL_TARGETS}, s as (select f.*, substr(seq, start + 1, \"end\" - start) as s from f join targets on owner = read), p as (select a.read, a.s, row_number() over (partition by a.read order by a.ord, b.ord) as n from s a join s b on a.read = b.read and a.ord < b.ord) select '@' || read || '_' || n || ' 1' || chr(10) || s || chr(10) || '+' || chr(10) || repeat('I', len(s)) as value from p")
def fastq_lines(spark: SparkSession, d: str) -> DataFrame:
    p = op.fragment_pairs(_fragments(spark, d)).join(targets(spark, d).withColumnRenamed("owner", "read"), "read")
    cut = lambda i: F.substring(F.col("seq"), F.col(f"start{i}") + 1, F.col(f"end{i}") - F.col(f"start{i}"))
    return sinks.paired_fastq_lines(p.withColumn("seq1", cut(1)).withColumn("seq2", cut(2)), 1)


@query("O4_O5_top_tiles", "Q_Name:l rank:l Block_Len:l", f"with {SQL_TILES} select \"Q_Name\", rank, \"Block_Len\" from (select *, row_number() over (partition by \"Q_Name\" order by \"Block_Len\" desc) as rank from tiles) where rank <= 3")
def top_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("Q_Name").orderBy(F.desc("Block_Len")))).where("rank <= 3")


@query("O4_O5_sorted_tiles", "Q_Name:l rank:l Matches:l Q_Start:l T_Name:s", "select l_suppkey as \"Q_Name\", row_number() over (partition by l_suppkey order by trunc(l_extendedprice)::bigint desc, l_orderkey * 10, 'chr' || (l_partkey % 7) || case l_returnflag when 'R' then '_MATERNAL' when 'A' then '_PATERNAL' else '' end) as rank, trunc(l_extendedprice)::bigint as \"Matches\", l_orderkey * 10 as \"Q_Start\", 'chr' || (l_partkey % 7) || case l_returnflag when 'R' then '_MATERNAL' when 'A' then '_PATERNAL' else '' end as \"T_Name\" from lineitem")
def sorted_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Every tile with its rank in the order of its contig."""
    return tiles(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("Q_Name").orderBy(F.desc("Matches"), "Q_Start", "T_Name")))


@query("S9_S10_paf_rows", "Q_Name:s Q_Len:l Q_Start:l Q_End:l Strand:s T_Name:s T_Start:l Matches:l Block_Len:l MapQ:l", "select 'q' || l_suppkey as \"Q_Name\", 100000 as \"Q_Len\", l_orderkey * 10 as \"Q_Start\", l_orderkey * 10 + l_quantity::bigint as \"Q_End\", case when l_linestatus = 'O' then '+' else '-' end as \"Strand\", 't' || (l_partkey % 7) as \"T_Name\", l_orderkey * 7 as \"T_Start\", l_linenumber as \"Matches\", l_quantity::bigint as \"Block_Len\", case when l_returnflag = 'R' then null else 60 end as \"MapQ\" from lineitem where l_returnflag <> 'A'")
def paf_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an alignment file: twelve columns and a tag, eleven for those returned, and some of too few."""
    q = F.col("l_quantity").cast("long")
    f = [F.concat(F.lit("q"), "l_suppkey"), F.lit(100_000), F.col("l_orderkey") * 10, F.col("l_orderkey") * 10 + q, F.when(F.col("l_linestatus") == "O", "+").otherwise("-"), F.concat(F.lit("t"), F.col("l_partkey") % 7), F.lit(90_000), F.col("l_orderkey") * 7, F.col("l_orderkey") * 7 + q, F.col("l_linenumber"), q]
    whole = F.concat_ws("\t", *[x.cast("string") for x in f])
    value = F.when(F.col("l_returnflag") == "N", F.concat(whole, F.lit("\t60\ttp:A:P"))).when(F.col("l_returnflag") == "R", whole).otherwise(F.concat_ws("\t", *[x.cast("string") for x in f[:9]]))
    return formats.paf_rows(table(spark, d, "lineitem").select(value.alias("value")))


@query("S11_contact_rows", "i:l j:l fwd:l bwd:l", "with t as (select l_partkey as i, l_suppkey as j, l_linenumber as fwd, l_quantity::bigint as bwd, l_orderkey * 100 + l_linenumber as line_no from lineitem), b as (select * from t union all select j, i, fwd, bwd, line_no from t) select i, j, arg_max(fwd, line_no) as fwd, arg_max(bwd, line_no) as bwd from b group by i, j")
def contact_rows(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat_ws("\t", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long"))
    return formats.contact_rows(table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), value.alias("value")))


@query("S5_fastq_records", "read_idx:l name:s comment:s len:l qual:s", "select item_id as read_idx, 'r' || item_id as name, case when item_id % 2 = 0 then 'x=1 y' end as comment, 1 + item_id % 30 as len, repeat('@', (1 + item_id % 30)::int) as qual from benchmark where item_id % 7 <> 3")
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    """Passages as lines of a file; the quality of some is too short."""
    n = (F.col("item_id") % 30 + 1).cast("int")
    head = F.concat(F.lit("@r"), "item_id", F.when(F.col("item_id") % 2 == 0, " x=1 y").otherwise(""))
    four = F.array(head, F.repeat(F.lit("A"), n), F.lit("+"), F.concat(F.repeat(F.lit("@"), n - 1), F.when(F.col("item_id") % 7 == 3, "").otherwise("@")))
    lines = table(spark, d, "benchmark").select("item_id", F.posexplode(four).alias("i", "value"))
    return formats.fastq_records(lines.select(F.lit("f").alias("file"), (F.col("item_id") * 4 + F.col("i")).alias("at"), "value")).withColumn("len", F.length("seq"))

"""Readers, writers and scalars on hand-made inputs."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import dna, scalars
from threadloom.operators import intervals, mapping, metrics
from threadloom.sources import formats, sinks


def test_gfa(spark, tmp_path):
    text = "H\tx\nS\ta\tACGTACGT\nS\tb\t*\tLN:i:30\nL\ta\t+\tb\t-\t5M1I2D\nL\tc\t+\ta\t+\t3:9\nX\n"
    (tmp_path / "g.gfa.gz").write_bytes(gzip.compress(text.encode()))
    segments, arcs = formats.read_gfa(spark, str(tmp_path / "g.gfa.gz"))
    assert {(r.name, r.len) for r in segments.collect()} == {("a", 8), ("b", 30), ("c", 0)}
    assert [r.name for r in segments.orderBy("seg_id").collect()] == ["a", "b", "c"]
    # an arc's overlap is the one on its target, cut to the source's length; complements are there
    assert {(r.v, r.w, r.ol, r.arc_len) for r in arcs.collect()} == {(0, 3, 6, 2), (2, 1, 6, 24), (4, 0, 0, 0), (1, 5, 8, 0)}


def test_sequences(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r1 first\nACGT\nAC\n+\nIIII\nII\n@r2\nAC\n+\n@I\n@bad\nACGT\n+\nII")
    got = formats.read_sequences(spark, str(tmp_path / "r.fq")).orderBy("read_idx").collect()
    assert [(r.name, r.comment, r.seq, r.qual) for r in got] == [("r1", "first", "ACGTAC", "IIIIII"), ("r2", None, "AC", "@I")]
    (tmp_path / "s.fa").write_text(">a x y\nACG\nT\n>b\nGG\n")
    assert {(r.name, r.comment, r.seq) for r in formats.read_fasta(spark, str(tmp_path / "s.fa")).collect()} == {("a", "x y", "ACGT"), ("b", None, "GG")}


def test_contacts_round_trip_and_swap(spark, tmp_path):
    c = spark.createDataFrame([(1, 2, 3, 4), (5, 0, 1, 0)], "i long, j long, fwd long, bwd long")
    sinks.write_contacts(c, str(tmp_path / "c"))
    got = {(r.i, r.j, r.fwd, r.bwd) for r in formats.read_contacts(spark, str(tmp_path / "c")).collect()}
    assert got == {(2, 1, 3, 4), (1, 2, 3, 4), (5, 0, 1, 0), (0, 5, 1, 0)}
    assert (2, 1, 4, 3) in {(r.i, r.j, r.fwd, r.bwd) for r in formats.read_contacts(spark, str(tmp_path / "c"), legacy_swap=True).collect()}


def test_groups_and_paf(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Node,type\n1,2\nbad\n1,3\n2,x\n")
    assert [(r.id, r.grp) for r in formats.read_groups(spark, str(tmp_path / "g.csv")).collect()] == [(1, 3)]
    (tmp_path / "a.paf").write_text("q\t9\t0\t9\t+\tt\t20\t1\t10\t8\t9\t60\tcs:Z:x\nshort\t1\n")
    assert [(r.Q_Name, r.T_End, r.MapQ) for r in formats.read_paf(spark, str(tmp_path / "a.paf")).collect()] == [("q", 10, 60)]


def test_reverse_complement_and_packing(spark):
    r = spark.range(1).select(dna.reverse_complement(F.lit("acgN-T")).alias("rc"), dna.unpack(dna.pack(F.lit("GATTACA")), 7).alias("p"), scalars.parse_number(F.lit("1.5K")).alias("n")).first()
    assert (r.rc, r.p, r.n) == ("ANNCGT", "GATTACA", 1500)


def test_long_sequences_have_all_windows(spark):
    s = spark.createDataFrame([(1, "ACGT" * 400)], "owner long, seq string")
    got = dna.kmers(s, 13)
    assert got.count() == 1600 - 12 and got.select("pos").distinct().count() == 1600 - 12


def test_opposite_strand_groups_of_few_hits(spark):
    h = spark.createDataFrame([(1, 1, i, i * 50, 1000 - i * 50, False) for i in range(4)], "read_idx long, target long, hit_seq long, qpos long, tpos long, strand boolean").withColumn("kmer", F.lit("x"))
    major = mapping.majority_strand(h)
    assert mapping.colinear(major).count() == 4
    assert mapping.target_support(mapping.colinear(major, strict=True), 13).count() == 0


def test_tile_keeps_little_overlap(spark):
    rows = [("q", "t1", 0, 100, 100, 90, "+"), ("q", "t2", 91, 191, 100, 80, "+"), ("q", "t3", 150, 250, 100, 70, "+"), ("q", "t4", 260, 270, 3, 60, "+")]
    t = spark.createDataFrame(rows, "Q_Name string, T_Name string, Q_Start long, Q_End long, Block_Len long, Matches long, Strand string")
    assert [r.T_Name for r in intervals.tile(t, least_block=5).collect()] == ["t1", "t2"]


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a len>5 b>c\r\nACGT\r\nAC\r\n>b\nGG\n\n>c\n")
    got = sorted((r.name, r.comment, r.seq) for r in formats.read_fasta(spark, str(tmp_path / "x.fa")).collect())
    assert got == [("a", "len>5 b>c", "ACGTAC"), ("b", None, "GG"), ("c", None, "")]


def test_fastq_in_splits(spark, tmp_path):
    rng, rows = random.Random(2), []
    for f in "xy":
        out = []
        for i in range(400):
            n = rng.randrange(1, 60)
            seq, qual = "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+>IH") for _ in range(n))
            rows.append((i, f"{f}{i}", "c d" if i % 2 else None, seq, qual))
            out.append(f"@{f}{i}{' c d' if i % 2 else ''}\n{seq}\n+\n{qual}\n")
        (tmp_path / f"{f}.fq").write_text("".join(out))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = formats.read_fastq(spark, str(tmp_path / "*.fq"))
        assert sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == sorted(map(str, rows))
        assert spark.read.text(str(tmp_path / "*.fq")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_long_gene_names_are_whole(spark):
    line = "chr1\tx\tgene\t1\t9\t.\t+\t.\tID=g;Name=" + "n" * 20_000
    assert formats.gff_genes(spark.createDataFrame([(line,)], "value string")).first().Gene_Name == "n" * 20_000


def test_rearrangements(spark):
    rows = [("q", "+", 0, 100, 0, 100), ("q", "+", 0, 100, 100, 100), ("q", "-", 200, 300, 200, 100), ("q", "+", 100, 400, 300, 300), ("none", "+", 5, 5, 0, 0)]
    t = spark.createDataFrame(rows, "Q_Name string, strand string, T_Start long, T_End long, Q_Start long, Block_Len long")
    got = {x.Q_Name: x for x in metrics.rearrangements(t).collect()}
    r = got["q"]
    # the second row repeats the first; a third of the fourth is covered by the third
    assert [round(x * 6, 9) for x in (r.dup, r.inv, r.rel, r.correct)] == [2, 1, 0, 3] and abs(r.IGI - (0.6 * 2 + 0.3) / 6) < 1e-9
    assert tuple(got["none"])[1:] == (0, 0, 0, 0, 0)


def _walked(rows, limit):
    """dup, inv, rel, correct of rows (strand, T_Start, T_End, Q_Start, Block_Len), base by base."""
    rows = sorted(rows, key=lambda r: (r[3], r[1], r[2], r[0], r[4]))
    sums = {s: sum(r[4] for r in rows if r[0] == s) for s in "+-"}
    main, seen, last, out = "+" if sums["+"] >= sums["-"] else "-", set(), None, [0.0] * 4
    for strand, a, b, _, size in rows:
        own = set(range(a, b))
        dup = size * len(own & seen) / len(own) if own else 0
        seen |= own
        out[0] += dup
        if strand != main:
            out[1] += size - dup
            continue
        gap = 0 if last is None else a - last[1] if main == "+" else last[0] - b
        out[2 if gap < -0.1 * (b - a) or gap > limit else 3] += size - dup
        last = (a, b)
    return [x / (sum(out) or 1) for x in out]


def test_rearrangements_by_brute_force(spark):
    rng, rows = random.Random(1), []
    for q in range(30):
        for _ in range(rng.randrange(1, 25)):
            a = rng.randrange(400)
            rows.append((q, rng.choice("+-"), a, a + rng.randrange(0, 90), rng.randrange(50), rng.randrange(0, 60)))
    t = spark.createDataFrame(rows, "Q_Name long, strand string, T_Start long, T_End long, Q_Start long, Block_Len long")
    for r in metrics.rearrangements(t, gap_limit=100).collect():
        want = _walked([x[1:] for x in rows if x[0] == r.Q_Name], 100)
        assert all(abs(a - b) < 1e-9 for a, b in zip((r.dup, r.inv, r.rel, r.correct), want, strict=True))


def test_quality_needs_a_peak():
    got = metrics.solve_quality([0, 9, 5, 3], [0, 9, 5, 3], 13)
    assert got["qv"] == -1 and got["cov"] == 1 and metrics.solve_quality([], [], 13)["qv_raw"] == -1


def test_quality_of_a_made_table():
    # counts around 30 with a valley at 6; of the sequence's k-mers 400 are not in the table, and few of low count are
    hist = [0.0, 90_000.0] + [60_000 / c**2 + 10_000 * math.exp(-(((c - 30) / 7) ** 2)) for c in range(2, 60)]
    cnt = [400.0, 0.0] + [0.01 * 60_000 / c**2 + 9_000 * math.exp(-(((c - 30) / 7) ** 2)) for c in range(2, 60)]
    got = metrics.solve_quality(hist, cnt, 31)
    total = sum(cnt)
    top = max(range(2, 60), key=lambda c: cnt[c])
    low = min(range(2, top), key=lambda c: cnt[c])
    cov = cnt[top] / hist[top]
    upper = min(1, min(cnt[c] / (cov * hist[c]) for c in range(2, top)))
    lower = max(0, (cnt[2] - cnt[low]) / (cov * (hist[2] - hist[low]))) if low > 2 and hist[2] > hist[low] else 0
    share = max(upper / 2 if upper < 0.00004 else 0.00004, lower)
    assert top == 30 and [got[x] for x in ("cov", "fpr_upper", "fpr_lower")] == pytest.approx([cov, upper, lower])
    assert got["qv_raw"] == pytest.approx(-10 * math.log10(math.log(total / (total - 400)) / 31))
    left = dict(enumerate(cnt))
    for c in range(low, top):
        left[c] = max(0, cnt[c] - (hist[c] - cnt[c] / cov) / (1 - share) * cov * share)
    # least squares of a quadratic by its normal equations
    xs = range(low, low + min(8, top - low + 1))
    a = np.array([[sum(x ** (i + j) for x in xs) for j in range(3)] for i in range(3)], float)
    b = np.array([sum(x**i * left[x + 1] / left[x] for x in xs) for i in range(3)])
    fit = np.linalg.solve(a, b)
    for c in range(low - 1, -1, -1):
        left[c] = left[c + 1] / max(1.01, fit[0] + fit[1] * c + fit[2] * c * c)
    assert got["err"] == pytest.approx(total - sum(left.values()), rel=1e-6) and got["qv"] == pytest.approx(-10 * math.log10(math.log(total / sum(left.values())) / 31), rel=1e-6)
    # a share of false hits above the upper bound is replaced by half of it
    assert metrics.solve_quality(hist, cnt, 31, fpr=0.9)["qv"] == pytest.approx(metrics.solve_quality(hist, cnt, 31, fpr=max(upper / 2, lower))["qv"])


def test_streamed_reads_map_like_a_batch(spark, tmp_path):
    from threadloom.operators.kmers import unique_owner_index
    from threadloom.streaming.ingest import map_stream, stream_reads

    base = "ACGTTGCAAGGCTTAACCGGATATCGCGTACCTGATTGACCAGTAGGCATTCA"
    t = spark.createDataFrame([(7, base)], "owner long, seq string")
    reads = spark.createDataFrame([(1, base[3:45])], "read_idx long, seq string")
    reads.write.parquet(str(tmp_path / "in"))
    index = unique_owner_index(t, 9).persist()
    map_stream(stream_reads(spark, str(tmp_path / "in")), index, 9, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.read_idx, r.target) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(r.read_idx, r.target) for r in mapping.map_reads(reads, t, 9).collect()] == [(1, 7)]

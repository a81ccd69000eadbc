"""Walks, sketches and tiles against brute force on small random inputs."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.functions import dna, scalars
from threadloom.operators import graph, intervals, sketch, walks


def _both(pairs):
    return sorted({(v, w) for v, w in pairs} | {(w ^ 1, v ^ 1) for v, w in pairs})


def _adjacency(pairs, lengths=None):
    rows = _both(pairs)
    return walks.Adjacency(pd.DataFrame({"v": [v for v, _ in rows], "w": [w for _, w in rows], "arc_len": [1] * len(rows)}), lengths)


def _random_dag(rng, n, p):
    return [(2 * i, 2 * j) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def _reach(out, start, stop):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        if v == stop:
            continue
        for w in out.get(v, ()):
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def test_superbubbles_are_those_of_the_definition():
    rng, found = random.Random(11), 0
    for _ in range(400):
        pairs = _random_dag(rng, rng.randrange(4, 9), rng.choice([0.25, 0.35, 0.5]))
        if not pairs:
            continue
        g, out, into = _adjacency(pairs), {}, {}
        for v, w in _both(pairs):
            out.setdefault(v, set()).add(w)
            into.setdefault(w, set()).add(v)
        for s in g.vertices:
            want = None
            if len(out.get(s, ())) > 1:
                # what s reaches before t is what reaches t after s; the least such set
                fits = [(len(a), t) for t in g.vertices if t != s for a in [_reach(out, s, t)] if t in a and a == _reach(into, t, s)]
                want = min(fits)[1] if fits else None
            got = walks.superbubble(g, s)
            assert (got[0] if got else None) == want, (pairs, s)
            if got:
                found += 1
                paths, rest = walks.bubble_paths(g, s, want)
                inside = {x for p in paths for x in p}
                assert not rest and set(got[1]) | {want} == inside == _reach(out, s, want) and len({tuple(p) for p in paths}) == len(paths)
    assert found > 50


def _simple_paths(g, start):
    todo = [[start]]
    while todo:
        p = todo.pop()
        yield p
        todo += [[*p, w] for w in g.after(p[-1]) if w not in p]


def test_most_vertices_by_brute_force():
    rng = random.Random(12)
    for _ in range(150):
        n = rng.randrange(3, 8)
        pairs = [(rng.randrange(2 * n), rng.randrange(2 * n)) for _ in range(rng.randrange(2, 10))]
        pairs = [(v, w) for v, w in pairs if v >> 1 != w >> 1]
        if not pairs:
            continue
        g = _adjacency(pairs)
        for s in g.vertices:
            path, complete = walks._most_vertices(g, s, 10**6)
            assert complete and path[0] == s and len(set(path)) == len(path) and all(w in g.after(v) for v, w in itertools.pairwise(path))
            assert len(path) == max(map(len, _simple_paths(g, s)))
    # a cycle of many ways, and few steps
    wheel = [(2 * i, 2 * j) for i in range(8) for j in range(8) if i != j]
    assert walks._most_vertices(_adjacency(wheel), 0, 5)[1] is False


def _members(spark, ids, part=0):
    return spark.createDataFrame([(i, part) for i in ids], "seg_id long, component long")


def _arcs(spark, pairs, lengths):
    return spark.createDataFrame([(v, w, 0, 1, lengths[v >> 1], lengths[w >> 1]) for v, w in _both(pairs)], "v long, w long, ol long, arc_len long, len_v long, len_w long")


def test_paths_from_tips(spark):
    a = _arcs(spark, [(0, 2), (2, 4), (0, 4), (4, 6), (4, 8)], [1] * 5)
    typed = spark.createDataFrame([(0, 3), (6, 3), (7, 3), (2, 2)], "v long, node_type int")
    got = {}
    for r in walks.depth_first_paths(a, _members(spark, range(5)), typed).orderBy("start", "ord").collect():
        got.setdefault(r.start, []).append(r.v)
    assert got == {0: [0, 2, 4, 6], 7: [7, 5, 3, 1]}


@pytest.mark.parametrize("seed", range(4))
def test_longest_and_breadth_first_paths_of_dags(spark, seed):
    rng = random.Random(seed)
    pairs = _random_dag(rng, 8, 0.35)
    lengths = [rng.randrange(1, 30) for _ in range(8)]
    g = _adjacency(pairs, dict(enumerate(lengths)))
    a, m = _arcs(spark, pairs, lengths), _members(spark, {x >> 1 for p in pairs for x in p})
    got = [r.v for r in walks.exhaustive_paths(a, m).orderBy("ord").collect()]
    starts = [s for s in g.vertices if not g.before(s)]
    longest = max(starts, key=lambda v: (lengths[v >> 1], -v))
    assert got[0] == longest and sum(lengths[v >> 1] for v in got) == max(sum(lengths[v >> 1] for v in p) for p in _simple_paths(g, longest))
    # the longest of the shortest ways to a leaf, a leaf reached first
    short = [min((len(p) for p in _simple_paths(g, s) if not g.after(p[-1]))) for s in starts]
    first = [r.v for r in walks.breadth_first_paths(a, m).orderBy("ord").collect()]
    assert len(first) == max(short) and not g.after(first[-1]) and all(w in g.after(v) for v, w in itertools.pairwise(first))
    order = {r.v: r.ord for r in walks.topological_order(a, m).collect()}
    assert set(order) == set(g.vertices) and all(order[v] < order[w] for v in g.vertices for w in g.after(v))


@pytest.mark.parametrize("seed", range(3))
def test_greedy_paths_follow_their_rule(spark, seed):
    rng = random.Random(40 + seed)
    pairs = _random_dag(rng, 9, 0.3)
    lengths = [rng.randrange(1, 1000) for _ in range(9)]
    g = _adjacency(pairs, dict(enumerate(lengths)))
    a, m = _arcs(spark, pairs, lengths), _members(spark, {x >> 1 for p in pairs for x in p})
    paths = {}
    for r in walks.greedy_paths(a, m, least=1).orderBy("path_no", "ord").collect():
        paths.setdefault(r.path_no, []).append(r.v)
    # by hand: a vertex counts as used with its other strand, but where a vertex has two arcs each way and an unused predecessor
    used, want = set(), []
    for first in (True, False):
        for v in g.vertices:
            if v in used or v ^ 1 in used or (first and g.before(v)):
                continue
            path = [v]
            while True:
                at = path[-1]
                used.add(at)
                if not (len(g.before(at)) == 2 and len(g.after(at)) == 2 and any(x not in used for x in g.before(at))):
                    used.add(at ^ 1)
                free = [w for w in g.after(at) if w not in used]
                if not free:
                    break
                path.append(max(free, key=lambda w: (lengths[w >> 1], -g.after(at).index(w))))
            want.append(path)
    assert list(paths.values()) == want


def test_chain_ends_that_meet(spark):
    a = spark.createDataFrame([(v, w) for v, w in _both([(4, 10), (4, 20), (14, 30), (24, 6)])], "v long, w long")
    chains = spark.createDataFrame([(0, 4), (10, 14), (20, 24), (30, 34)], "begin long, end long")
    got = {(r.begin, r.end): (r.side, r.w) for r in graph.chain_ends_met(a, chains, spark.createDataFrame([(30,)], "v long")).collect()}
    assert got == {(0, 4): (1, 10)}


def test_tiles_by_brute_force(spark):
    rng, rows = random.Random(6), []
    for q in range(12):
        for i in range(rng.randrange(1, 40)):
            a = rng.randrange(300)
            rows.append((q, f"t{i:02}", a, a + rng.randrange(1, 80), rng.randrange(1, 20), rng.randrange(8)))
    t = spark.createDataFrame(rows, "Q_Name long, T_Name string, Q_Start long, Q_End long, Block_Len long, Matches long")
    want = set()
    for q in range(12):
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[5], r[2], r[1])):
            over = sum(len(set(range(r[2], r[3])) & set(range(k[2], k[3]))) for k in kept)
            if over < 0.1 * (r[3] - r[2]):
                kept.append(r)
        want |= {r for r in kept if r[4] >= 5}
    assert {tuple(r) for r in intervals.tile(t, least_block=5).collect()} == want


_TURN = str.maketrans("ACGT", "TGCA")


def _least(x):
    return min(x, x.translate(_TURN)[::-1])


def test_minimizers_of_both_strands_by_brute_force(spark):
    rng = random.Random(9)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 700)))) for i in range(6)]
    want = []
    for i, s in seqs:
        x = [_least(s[p : p + 5]) for p in range(len(s) - 4)]
        low = [min(x[p : p + 8]) for p in range(len(x) - 7)]
        for _, run in itertools.groupby(range(len(low)), key=lambda p: low[p]):
            run = list(run)
            want.append((i, run[0], run[-1] + 1, low[run[0]]))
    got = sketch.minimizer_runs(spark.createDataFrame(seqs, "seq_id long, seq string"), 5, 8, canonical=True)
    assert sorted((r.seq_id, r.start, r.end, r.minimizer) for r in got.collect()) == sorted(want)


def test_modimizers_and_least_hashes_by_brute_force(spark):
    rng = random.Random(10)
    seqs = [(i, "".join(rng.choice("ACGTN" if i == 2 else "ACGT") for _ in range(400))) for i in range(4)]
    windows = [(i, p, s[p : p + 11]) for i, s in seqs for p in range(390) if "N" not in s[p : p + 11]]
    hashed = spark.createDataFrame([(i, p, _least(x), x < x.translate(_TURN)[::-1], x) for i, p, x in windows], "seq_id long, pos int, k string, fwd boolean, raw string")
    both = hashed.withColumn("h", F.xxhash64("k")).withColumn("a", F.xxhash64("raw", F.lit(7))).withColumn("b", F.xxhash64(dna.reverse_complement(F.col("raw")), F.lit(7))).collect()
    want = {(r.seq_id, r.pos, r.h, r.fwd) for r in both if r.h % 4 == 0}
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    assert {tuple(r) for r in sketch.modimizers(df, 11, 4).select("seq_id", "pos", "hash", "fwd").collect()} == want and len(want) > 100
    k = dna.kmers(df, 11, keep=("seq_id",)).groupBy("seq_id").agg(F.min(scalars.minimum_hash(F.col("kmer"), dna.reverse_complement(F.col("kmer")))).alias("h"))
    least = {}
    for r in both:
        least[r.seq_id] = min(least.get(r.seq_id, 2**63), r.a, r.b)
    assert {r.seq_id: r.h for r in k.collect()} == least

"""Small graphs, made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph, walks


def _arcs(spark, pairs, ol=5):
    both = {(v, w) for v, w in pairs} | {(w ^ 1, v ^ 1) for v, w in pairs}
    return spark.createDataFrame([(v, w, ol, 100) for v, w in sorted(both)], "v long, w long, ol long, arc_len long")


def _members(spark, n):
    return spark.createDataFrame([(i, 0) for i in range(n)], "seg_id long, component long")


def test_a_bubble_within_a_bubble_gives_both(spark):
    # 0 to 2 and 4, 2 to 6 and 8, both to 10, 10 and 4 to 12
    a = _arcs(spark, [(0, 2), (0, 4), (2, 6), (2, 8), (6, 10), (8, 10), (10, 12), (4, 12)])
    b = walks.find_bubbles(a, _members(spark, 7))
    found = {(r.s, r.t) for r in b.select("s", "t").distinct().collect()}
    assert found == {(0, 12), (2, 10), (13, 1), (11, 3)}
    assert b.where("s = 0 and t = 12").select("path_no").distinct().count() == 3


def test_bubbles_commute_with_complements(spark):
    a = _arcs(spark, [(0, 2), (0, 4), (2, 6), (4, 6), (6, 8), (6, 10), (8, 12), (10, 12)])
    found = {(r.s, r.t) for r in walks.find_bubbles(a, _members(spark, 7)).select("s", "t").distinct().collect()}
    assert found == {(t ^ 1, s ^ 1) for s, t in found} == {(0, 6), (6, 12), (7, 1), (13, 7)}


def test_a_sink_that_leads_back_is_no_bubble(spark):
    a = _arcs(spark, [(0, 2), (0, 4), (2, 6), (4, 6), (6, 0)])
    assert walks.find_bubbles(a, _members(spark, 4)).count() == 0


def test_two_cycles_are_cut(spark):
    a = spark.createDataFrame([(0, 2, 1, 1), (2, 0, 1, 1), (4, 6, 1, 1)], "v long, w long, ol long, arc_len long")
    assert [(r.v, r.w) for r in graph.remove_two_cycles(a).collect()] == [(4, 6)]


def test_components_of_a_long_path(spark):
    n = 200
    a = spark.createDataFrame([(2 * i, 2 * i + 2, 1, 1) for i in range(n)] + [(1000, 1002, 1, 1)], "v long, w long, ol long, arc_len long")
    got = {r.seg_id: r.component for r in graph.components(a).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {500: 500, 501: 500}


def test_tables_go_when_they_are_told_to(spark):
    from pathlib import Path

    from threadloom.plans.staging import folder, settle, temporary_tables

    here = lambda: {p.name for p in Path(folder(spark).removeprefix("file:")).iterdir()}
    before = here()
    with temporary_tables(spark) as keep:
        settle(spark.range(3))
        kept = keep(settle(spark.range(4)))
        assert len(here() - before) == 2
    assert len(here() - before) == 1 and kept.count() == 4


def test_components_by_brute_force(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(350)] + [(7, 900 + i) for i in range(400)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        x, y = sorted((find(x), find(y)))
        root[y] = x
    a = spark.createDataFrame([(2 * x, 2 * y + 1, 1, 1) for x, y in pairs], "v long, w long, ol long, arc_len long")
    assert {r.seg_id: r.component for r in graph.components(a).collect()} == {x: find(x) for x in root}


def test_components_of_an_empty_graph(spark):
    assert graph.components(spark.createDataFrame([], "v long, w long")).count() == 0


def test_largest_overlap_stays(spark):
    a = spark.createDataFrame([(0, 2, 5, 95), (0, 2, 9, 91)], "v long, w long, ol long, arc_len long")
    assert graph.one_arc_each(a).first().ol == 9


def _sized(spark, pairs, lengths):
    return _arcs(spark, pairs).withColumn("len_v", F.element_at(F.array(*map(F.lit, lengths)), (F.shiftright("v", 1) + 1).cast("int"))).withColumn("len_w", F.element_at(F.array(*map(F.lit, lengths)), (F.shiftright("w", 1) + 1).cast("int")))


def test_greedy_path_takes_the_longest_neighbour(spark):
    a = _sized(spark, [(0, 2), (0, 4), (2, 6), (4, 6)], [10, 50, 80, 10])
    got = walks.greedy_paths(a, _members(spark, 4), least=1).orderBy("path_no", "ord").collect()
    assert [r.v for r in got if r.path_no == 0] == [0, 4, 6]


def test_exhaustive_path_is_complete(spark):
    a = _sized(spark, [(0, 2), (0, 4), (2, 6), (4, 6)], [10, 50, 80, 10])
    got = walks.exhaustive_paths(a, _members(spark, 4)).orderBy("ord").collect()
    assert [r.v for r in got] in ([0, 4, 6], [7, 5, 1]) and all(r.complete for r in got)


@pytest.mark.parametrize(("ol", "length"), [(3, 4 + 4 - 3), (0, 4 + 500 + 4), (4, 8), (9, 8)])
def test_sequences_are_joined(spark, ol, length):
    s = spark.createDataFrame([(0, "AAAA"), (1, "CCCC")], "seg_id long, seq string")
    p = spark.createDataFrame([(1, 0, 0), (1, 1, 2)], "path long, ord int, v long")
    a = spark.createDataFrame([(0, 2, ol, 1)], "v long, w long, ol long, arc_len long")
    r = walks.join_sequences(p, s, a).first()
    assert (len(r.seq), r.is_valid, r.positions) == (length, True, [0, 4])


def _tips(spark, rows):
    return spark.createDataFrame(rows, "component long, v long, kind string, partner long")


#: 0 to a tip 2 and its sibling 4, from which seven bubbles follow.
_FORK = [(0, 2), (0, 4), (4, 6)] + [x for i in range(7) for s in [6 + 6 * i] for x in ((s, s + 2), (s, s + 4), (s + 2, s + 6), (s + 4, s + 6))]


@pytest.mark.parametrize(("length", "joined"), [(100, True), (84, False)])
def test_branch_tip_is_joined_to_what_follows_its_sibling(spark, length, joined):
    a = _sized(spark, _FORK, [100, length] + [100] * 23)
    m = _members(spark, 25)
    got = walks.repair_arcs(a, m, walks.node_types(walks.find_bubbles(a, m)), _tips(spark, [(0, 2, "branch", None)]))
    assert {(r.v, r.w) for r in got.collect()} == ({(2, 6), (7, 3)} if joined else set())


def test_tip_is_joined_to_the_one_it_turns_to_and_no_more(spark):
    a = _sized(spark, _FORK, [100] * 25)
    m = _members(spark, 25)
    got = walks.repair_arcs(a, m, walks.node_types(walks.find_bubbles(a, m)), _tips(spark, [(0, 2, "branch", None), (0, 2, "turn", 0)]))
    assert {(r.v, r.w) for r in got.collect()} == {(2, 0), (1, 3)}


def test_branch_tip_that_got_an_arc_leads_to_the_next_bubble_end(spark):
    # a bubble before the fork; its sibling 4 has an arc to 61, the other strand of tip 60, without the complement, so that only the repair gives 60 an arc
    pairs = [*_FORK, (50, 52), (50, 54), (52, 0), (54, 0), (61, 62), (61, 64)]
    a = _sized(spark, pairs, [100] * 33)
    m = _members(spark, 33)
    typed = walks.node_types(walks.find_bubbles(a, m))
    a = a.unionByName(spark.createDataFrame([(4, 61, 5, 100, 100, 100)], a.schema))
    tips = _tips(spark, [(0, 2, "branch", None), (0, 60, "branch", None)])
    got = {(r.v, r.w) for r in walks.repair_arcs(a, m, typed, tips).collect()}
    repaired = {(2, 6), (7, 3), (2, 61), (60, 3)}
    assert got == repaired | {(62, 1), (0, 63), (64, 1), (0, 65)}


def _nested(n):
    """A bubble around a row of n: the paths from 0 to 6n + 2 by way of the row are 2 ** n, and one leads past it."""
    row = [x for i in range(n) for s in [2 + 6 * i] for x in ((s, s + 2), (s, s + 4), (s + 2, s + 6), (s + 4, s + 6))]
    end = 6 * n + 4
    return [(0, 2), (0, end + 2), (6 * n + 2, end), (end + 2, end), *row], end


def test_bubble_of_very_many_paths_is_whole(spark):
    pairs, end = _nested(40)
    a, m = _arcs(spark, pairs), _members(spark, end // 2 + 2)
    b = walks.bubble_nodes(a, m)
    got = b.where(f"s = 0 and t = {end}").collect()
    assert len(got) == end // 2 + 2 and {int(r.n_paths) for r in got} == {2**40 + 1}
    types = {r.v: r.node_type for r in walks.node_types(b).collect()}
    assert all(types[v] == (1 if v in (0, end) else 2) for v in range(0, end + 3, 2))
    pure = {r.v: (r.pure_in, r.pure_out) for r in walks.pure_degrees(a, m, b).collect()}
    assert pure == {0: (0, 1), 1: (1, 0), end: (1, 0), end + 1: (0, 1)}


def test_path_listing_that_runs_out_of_steps_says_so(spark):
    pairs, end = _nested(3)
    a, m = _arcs(spark, pairs), _members(spark, end // 2 + 2)
    few = walks.find_bubbles(a, m, most=10).where(f"s = 0 and t = {end}")
    assert [r.complete for r in few.select("complete").distinct().collect()] == [False]
    assert [r.complete for r in walks.find_bubbles(a, m).select("complete").distinct().collect()] == [True]


def test_longest_path_is_exact_beyond_the_step_limit(spark):
    pairs, end = _nested(40)
    lengths = [10 + (i % 3) for i in range(end // 2 + 2)]
    got = walks.exhaustive_paths(_sized(spark, pairs, lengths), _members(spark, end // 2 + 2)).orderBy("ord").collect()
    assert all(r.complete for r in got)
    assert sum(lengths[r.v >> 1] for r in got) == max(sum(lengths[v >> 1] for v in p) for p in _best(pairs, lengths, end))


def _best(pairs, lengths, end):
    """The longest paths from either end, by brute force over the order of vertices."""
    out = []
    for arcs, first in ((pairs, 0), ([(w, v) for v, w in pairs], end)):
        best = {first: [first]}
        for _ in range(end):
            grown = {w: [*best[v], w] for v, w in arcs if v in best and sum(lengths[x >> 1] for x in [*best[v], w]) > sum(lengths[x >> 1] for x in best.get(w, []))}
            if not grown:
                break
            best |= grown
        out += best.values()
    return out

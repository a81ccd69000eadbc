"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from threadloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(rows):
    return sorted(tuple("" if v is None or v != v else repr(round(v, 7)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert _plain([tuple(r[c] for c in columns) for r in df.collect()]) == _plain(got.fetchall())


def test_every_query_has_sql_or_is_known_to_have_none():
    none = set(registry.queries()) - set(SQL)
    assert none == {
        "F21_minimum_hash", "W8_canonical_minimizers", "W9_modimizers", "W10_distinct_minimizers", "A26_quality_values", "Q3_strict_mapping", "J8_chain_ends_met", "A20_G20_pure_degrees", "G21_G22_chains", "G16_G17_classify_tips",
        "G18_G19_repair_arcs", "G26_P13_greedy_paths", "G27_exhaustive_paths", "G28_G29_breadth_first_paths", "G31_topological_order", "T1_P14_tile", "G33_G23_phased_chains", "G34_plant_paths", "G29_depth_first_paths",
    }


def test_distinct_minimizers_come_from_all_items(spark):
    from threadloom.plans.relations import items

    got = {r.grp for r in registry.queries()["W10_distinct_minimizers"](spark, DATA).select("grp").distinct().collect()}
    sizes = [(r.owner, len(r.seq)) for r in items(spark, DATA).collect()]
    assert got == {owner // 2 for owner, n in sizes if n >= 14} and len(got) * 2 >= len(sizes) - 1


def test_distinct_minimizers_need_every_sequence_of_their_group(spark):
    from threadloom.operators import sketch

    runs = spark.createDataFrame([(0, 0, 4, "A"), (1, 0, 2, "A"), (1, 2, 6, "C"), (2, 0, 3, "A"), (4, 1, 3, "A")], "seq_id long, start long, end long, minimizer string")
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "seq_id long, grp long")
    assert {(r.grp, r.start, r.end) for r in sketch.distinct_everywhere(runs, groups).collect()} == {(0, 2, 4), (2, 1, 3)}


def test_every_tile_has_a_rank(spark):
    got = registry.queries()["O4_O5_sorted_tiles"](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()

"""Queries on what only large tables have: long keys, frequent k-mers, many components."""

import duckdb

from threadloom.plans import registry


def _table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def _of_sql(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return con.execute(registry.oracle_sql()[name])


def test_keys_of_seven_digits_are_matched_whole(spark, tmp_path):
    _table(spark, tmp_path, "part", [(1_000_123, 30), (7, 30), (1_200_000, 30), (12, 1)], "p_partkey long, p_size int")
    _table(spark, tmp_path, "orders", [(1, 100_012), (2, 7), (3, 1_000_123), (4, 12), (5, 120_000), (6, None)], "o_orderkey long, o_custkey long")
    got = registry.queries()["J9_K8_graph_intersection"](spark, str(tmp_path)).collect()
    assert {(r.Q_Name, r.T_Name) for r in got} == set(_of_sql(tmp_path, "J9_K8_graph_intersection", "part", "orders").fetchall())
    assert {r.Q_Name for r in got} == {2, 3}


def _sequences(spark):
    import random

    r = random.Random(3)
    words = ["".join(r.choice("ACGT") for _ in range(r.randint(3, 40))) for _ in range(12)] + ["N", "ACG" * 30]
    rows = [(i, "".join(r.choices(words, k=r.randint(0, 12)))) for i in range(60)] + [(70, None), (71, "ACG"), (72, "acgtn" * 4)]
    return spark.createDataFrame(rows, "owner long, seq string").repartition(5)


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_totals_equal_the_rows_they_stand_for(spark, monkeypatch):
    from pyspark.sql import functions as F

    from threadloom.functions.dna import kmers as windows
    from threadloom.operators import kmers, mapping

    s = _sequences(spark)
    reads = s.where("owner % 7 = 0").select((F.col("owner") * 2).alias("read_idx"), "seq")
    for k in (4, 13, 20, 31, 33):
        occurrences = kmers.repeat_occurrences(s, k).groupBy("owner").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))
        assert _rows(kmers.repeat_totals(s, k), "owner", "n", "sum_pos") == _rows(occurrences, "owner", "n", "sum_pos") != []
        assert _rows(kmers.count_kmers(s, k, saturate=9), "kmer", "n") == _rows(windows(s, k).groupBy("kmer").agg(F.least(F.count("*"), F.lit(9)).alias("n")), "kmer", "n")
        h = mapping.anchor_hits_with_repeats(reads, kmers.unique_owner_index(s, k), kmers.all_occurrences(s, k), k)
        hits = _rows(h.groupBy("read_idx").agg(F.count("*").alias("n"), F.sum("tpos").alias("sum_t")), "read_idx", "n", "sum_t")
        for most in (500_000, 3):  # 3: k-mers of reads are too many to broadcast
            monkeypatch.setattr(mapping, "BROADCAST_KMERS", most)
            assert _rows(mapping.hit_totals(reads, s, k), "read_idx", "n", "sum_t") == hits != []


def test_pieces_of_long_texts_and_full_tasks_lose_no_kmer(monkeypatch):
    import random

    from threadloom.operators import kmers

    text = "".join(random.Random(5).choices("ACGTN", [9, 9, 9, 9, 1], k=3000))
    whole = [tuple(x.tolist()) for x in kmers._packed(text, 13)]
    monkeypatch.setattr(kmers, "PIECE", 100)
    got = [x for x in kmers._pieces(["ACGT", text], 13) if len(x[0])]
    assert {int(r) for x in got for r in x[0]} == {1}
    assert [tuple(int(v) for x in got for v in x[i]) for i in (1, 2)] == whole[:2]


def test_these_queries_shuffle_no_occurrences(spark):
    """What a task hands on to be counted is a row a k-mer, not a row an occurrence."""
    from threadloom.operators import kmers

    s = spark.createDataFrame([(i, "ACGTTGCA" * 200) for i in range(50)], "owner long, seq string").repartition(2)
    assert kmers._counted(s, 13).count() <= 8 * 2 < kmers.all_occurrences(s, 13).count()


def test_spectra_are_those_of_single_kmers(spark):
    """Quality values come from counts by slice; what they stand for is each k-mer's own count."""
    from pyspark.sql import functions as F

    from threadloom.functions.dna import kmers as windows
    from threadloom.operators import kmers, metrics

    s = _sequences(spark)
    asked = s.where("owner % 5 = 0").unionByName(spark.createDataFrame([(90, "GATTACA" * 9), (91, None), (70, "ACGTTTTGGA"), (92, "nnACGTACGGT")], "owner long, seq string"))
    for k, saturate in ((4, 9), (13, 2**22), (31, 3)):
        counts = kmers.count_kmers(s, k, saturate=saturate)
        hist, spectra = kmers.count_spectra(s, asked, k, saturate)
        assert _rows(hist, "n", "hist") == _rows(kmers.count_histogram(counts), "n", "kmers") != []
        single = metrics.quality_histogram(windows(asked, k).select(F.col("owner").alias("seq"), "kmer"), counts)[1]
        assert _rows(metrics.known_windows(spectra), "n", "cnt") == _rows(single, "n", "cnt") != []
        empty, none = kmers.count_spectra(s.where("false"), asked, k)
        assert empty.collect() == [] and {r.n for r in none.collect()} <= {0}


def _many_graphs(spark, seed=8):
    """Small random graphs, many of one shape, as arcs, members and segments."""
    import random

    rng = random.Random(seed)
    arcs, members, segments = [], [], []
    ladder = [(0, 2), (0, 4), (2, 6), (4, 6), (6, 8), (6, 10), (8, 12), (10, 12)]
    fork = [(0, 2), (0, 4), (4, 6)] + [x for i in range(7) for s in [6 + 6 * i] for x in ((s, s + 2), (s, s + 4), (s + 2, s + 6), (s + 4, s + 6))]
    for c in range(90):
        n = rng.randint(2, 7)
        pairs = [ladder, fork, [(rng.randrange(2 * n), rng.randrange(2 * n)) for _ in range(rng.randint(1, 9))], [(0, 2), (2, 4)]][c % 4]
        base = 100 * c
        both = {(v, w) for v, w in pairs} | {(w ^ 1, v ^ 1) for v, w in pairs}
        arcs += [(2 * base + v, 2 * base + w, 5, rng.randint(-1, 6)) for v, w in sorted(both)]
        ids = sorted({x >> 1 for p in both for x in p})
        members += [(base + i, base + ids[0]) for i in ids]
        segments += [(base + i, rng.choice([100, 100, 95, 50])) for i in ids]
    frame = spark.createDataFrame
    return frame(arcs, "v long, w long, ol long, arc_len long"), frame(members, "seg_id long, component long"), frame(segments, "seg_id long, len long")


def test_walks_by_shape_equal_walks_of_each_component(spark):
    from pyspark.sql import functions as F

    from threadloom.operators import graph, walks

    a, m, s = _many_graphs(spark)
    rows = walks.walk_rows(a, m, s)
    b = walks.bubble_nodes(a, m)
    single = walks.extract_chains(a, m, walks.pure_degrees(a, m, b), walks.node_types(b))
    names = ("component", "begin", "end", "node", "is_hap_only")
    assert _rows(walks.chains_of(rows), *names) == _rows(single, *names) != []
    for end in ("v", "w"):
        a = a.withColumn("seg_id", F.shiftright(end, 1)).join(s.withColumnRenamed("len", f"len_{end}"), "seg_id").drop("seg_id")
    kinds = walks.node_types(b)
    loose = graph.degrees(a).where("n_out = 0 and n_in > 0").join(kinds, "v", "left_anti").select(F.explode(F.array(F.col("v"), F.col("v").bitwiseXOR(F.lit(1)))).alias("v")).distinct()
    t = kinds.join(loose, "v", "left_anti").unionByName(loose.withColumn("node_type", F.lit(3)))
    single = walks.repair_arcs(a, m, t, walks.classify_tips(a, m, t))
    assert _rows(walks.repairs_of(rows), "component", "v", "w") == _rows(single, "component", "v", "w") != []


def test_short_ladder_is_the_ladder(spark):
    from threadloom.plans import relations

    d = "/root/testdata/sf0.001"
    assert relations.short_orders(spark, d)
    rows = relations.short_ladder(spark, d)
    whole = relations.ladder(spark, d)
    assert _rows(rows.where("w >= 0"), "v", "w", "ol", "arc_len") == _rows(whole, "v", "w", "ol", "arc_len") != []
    members = relations.ladder_members(spark, d).join(relations.ladder_segments(spark, d), "seg_id").selectExpr("component", "seg_id * 2 as v", "len")
    assert _rows(rows.where("w = -1"), "component", "v", "len") == _rows(members, "component", "v", "len")


def test_walks_by_shape_shuffle_no_component_twice(spark):
    """A component is walked where the sort of lines leaves it: the plan's one exchange is that of the lines."""
    from threadloom.operators import walks
    from threadloom.plans import relations

    plan = walks.chains_of(relations.short_ladder(spark, "/root/testdata/sf0.001"), True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_repair_query_joins_nothing(spark):
    plan = registry.queries()["G18_G19_repair_arcs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_greedy_paths_by_shape_equal_those_of_each_component(spark):
    from pyspark.sql import functions as F

    from threadloom.operators import walks

    a, m, s = _many_graphs(spark)
    rows = walks.walk_rows(a, m, s)
    for end in ("v", "w"):
        a = a.withColumn("seg_id", F.shiftright(end, 1)).join(s.withColumnRenamed("len", f"len_{end}"), "seg_id").drop("seg_id")
    names = ("component", "path_no", "ord", "v")
    for least in (1, 250):
        assert _rows(walks.greedy_paths_of(rows, least), *names) == _rows(walks.greedy_paths(a, m, least), *names) != []


def _orders_of_customers(spark, folder, extra=()):
    """Orders of one to seven lines, some customers with many of four or seven; a customer without a key, orders that the table of orders lacks."""
    import random

    rng, lines, orders = random.Random(4), [], []
    for o in range(1, 150):
        customer = rng.choice([1, 2, 3, None, *range(10, 40)])
        count = rng.choice([4, 7]) if o % 3 else rng.randint(1, 7)
        lines += [(o, n, rng.randrange(99), 5, float(rng.choice([0, *range(1, 51)])), 1.0, 0.0, 0.0, "N", "O", 1) for n in range(1, count + 1)]
        orders += [(o, customer)] if o % 20 else []
    _table(spark, folder, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate int")
    _table(spark, folder, "orders", [*orders, *extra], "o_orderkey long, o_custkey long")
    return str(folder)


def _phase_unused(monkeypatch):
    from threadloom.plans import drivers

    monkeypatch.setattr(drivers, "phase", lambda *a, **k: (_ for _ in ()).throw(AssertionError("components are known, yet sought by rounds")))


def test_phased_chains_of_customers_take_one_walk(spark, tmp_path, monkeypatch):
    from threadloom.plans import drivers, graph_queries

    d = _orders_of_customers(spark, tmp_path)
    p = drivers.phase(*graph_queries._long_ladder(spark, d), least_path=30_000)
    _phase_unused(monkeypatch)
    names = ("length", "n_nodes")
    assert _rows(registry.queries()["G33_G23_phased_chains"](spark, d), "begin", "end_", *names) == _rows(p.long, "begin", "end", *names) != []


def test_an_order_of_two_customers_joins_their_components(spark, tmp_path):
    from threadloom.plans import drivers, graph_queries

    d = _orders_of_customers(spark, tmp_path, extra=[(1, 2), (2, 1), (4, 3)])
    assert graph_queries._long_rows(spark, d) is None
    p = drivers.phase(*graph_queries._long_ladder(spark, d), least_path=30_000)
    names = ("length", "n_nodes")
    assert _rows(registry.queries()["G33_G23_phased_chains"](spark, d), "begin", "end_", *names) == _rows(p.long, "begin", "end", *names) != []


def test_chains_of_a_repaired_graph_take_one_walk(spark):
    """Tips, arcs to add, linear vertices and kinds come out of the walk as they do stage by stage."""
    import random

    from threadloom.operators import graph, walks
    from threadloom.plans import drivers

    def ladder(n, start):
        return [x for i in range(n) for s in [start + 6 * i] for x in ((s, s + 2), (s, s + 4), (s + 2, s + 6), (s + 4, s + 6))]

    rng = random.Random(6)
    pairs = [*ladder(8, 0), (48, 200), (48, 202), (202, 300), *ladder(8, 300), *ladder(10, 1000), *ladder(2, 2000)]
    for c in range(12):  # ladders with odd arcs: tips, turns, cycles, bridges of linear vertices
        at, n = 10_000 + 1000 * c, rng.randint(4, 12)
        pairs += ladder(n, at)
        pairs += [(at + rng.randrange(6 * n + 2), at + rng.randrange(6 * n + 40)) for _ in range(rng.randint(1, 4))]
    arcs = sorted({(v, w) for v, w in pairs} | {(w ^ 1, v ^ 1) for v, w in pairs})
    length = {s: rng.choice([9_000, 10_000, 10_500, 60_000]) for v, w in arcs for s in (v >> 1, w >> 1)}
    a = spark.createDataFrame([(v, w, 5, length[v >> 1] - 5) for v, w in arcs], "v long, w long, ol long, arc_len long")
    s = spark.createDataFrame([(i, f"s{i}", "ACGT", n) for i, n in sorted(length.items())], "seg_id long, name string, seq string, len long")
    p = drivers.phase(s, a)
    assert p.added.count() > 0 and {r.kind for r in p.kinds.collect()} == {"kept", "hap"}
    members = graph.components(a)
    names = ("begin", "end", "length", "n_nodes")
    assert _rows(walks.phased_chains_of(walks.walk_rows(a, members, s)), *names) == _rows(p.long, *names) != []


def test_plant_paths_of_customers_take_one_walk(spark, tmp_path, monkeypatch):
    from threadloom.plans import drivers, graph_queries

    d = _orders_of_customers(spark, tmp_path)
    p = drivers.phase(*graph_queries._long_ladder(spark, d), least_path=30_000, plant=True)
    _phase_unused(monkeypatch)
    names = ("component", "path_no", "ord", "v")
    assert _rows(registry.queries()["G34_plant_paths"](spark, d), *names) == _rows(p.paths, *names) != []

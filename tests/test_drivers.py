"""Whole runs: mates to contacts, and a graph to chains."""

import random

from pyspark.sql import functions as F

from threadloom.plans import drivers


def _ladder(n, start=0):
    """Arcs of n bubbles in a row from vertex start: two ways each."""
    pairs = []
    for i in range(n):
        s = start + 6 * i
        pairs += [(s, s + 2), (s, s + 4), (s + 2, s + 6), (s + 4, s + 6)]
    return pairs


def _graph(spark, pairs, length=10_000):
    both = sorted({(v, w) for v, w in pairs} | {(w ^ 1, v ^ 1) for v, w in pairs})
    arcs = spark.createDataFrame([(v, w, 5, length - 5) for v, w in both], "v long, w long, ol long, arc_len long")
    ids = sorted({x >> 1 for p in both for x in p})
    rng = random.Random(3)
    segments = spark.createDataFrame([(i, f"s{i}", "".join(rng.choice("ACGT") for _ in range(40)), length) for i in ids], "seg_id long, name string, seq string, len long")
    return segments, arcs


def test_phase_of_a_ladder(spark):
    # ten bubbles in a row are kept as one chain; two in a row are few vertices and so a haplotype's
    pairs = _ladder(10) + _ladder(1, start=1000)
    p = drivers.phase(*_graph(spark, pairs), least_path=20_000)
    kinds = {r.component: r.kind for r in p.kinds.collect()}
    assert kinds == {0: "kept", 500: "hap"}
    long = {(r.begin, r.end): (r.length, r.n_nodes) for r in p.long.collect()}
    assert long == {(0, 60): (310_000, 31), (61, 1): (310_000, 31)}
    assert {r.seg_id for r in p.nodes.where("begin = 0").collect()} == set(range(31))
    paths = {}
    for r in p.paths.orderBy("component", "path_no", "ord").collect():
        paths.setdefault((r.component, r.path_no), []).append(r.v)
    assert {c for c, _ in paths} == {500} and any(x[0] >> 1 in (500, 503) and x[-1] >> 1 in (500, 503) and len(x) == 3 for x in paths.values())
    assert p.summary.first().asDict() == {"n_bubble": 31, "n_hap": 4, "n_chain": 31, "n_missing": 0}
    plant = drivers.phase(*_graph(spark, pairs), least_path=20_000, plant=True)
    assert {r.kind for r in plant.kinds.collect()} == {"hap"} and plant.long.count() == 0 and {r.component for r in plant.paths.collect()} == {0, 500}


def test_phase_repairs_a_branch_tip(spark):
    # between bubbles 5 and 6 a vertex forks to 200 and 202, of which 202 alone leads on
    left, right = _ladder(8), _ladder(8, start=300)
    pairs = [*left, (48, 200), (48, 202), (202, 300), *right]
    p = drivers.phase(*_graph(spark, pairs), least_path=20_000)
    assert {(r.v, r.w) for r in p.added.collect()} >= {(200, 300), (301, 201)}
    assert {(r.begin, r.end) for r in p.long.collect()} >= {(0, 348), (349, 1)}
    assert p.bubbles.where("s = 48 and t = 300").count() == 4


def test_phase_of_files(spark, tmp_path):
    segments, arcs = _graph(spark, _ladder(8))
    names = {r.seg_id: r.name for r in segments.collect()}
    lines = [f"S\t{n}\t*\tLN:i:10000" for _, n in sorted(names.items())] + [f"L\t{names[r.v >> 1]}\t{'+-'[r.v & 1]}\t{names[r.w >> 1]}\t{'+-'[r.w & 1]}\t5M" for r in arcs.collect()]
    (tmp_path / "g.gfa").write_text("\n".join(lines) + "\n")
    drivers.phase_files(spark, str(tmp_path / "g.gfa"), str(tmp_path / "out"))
    links = {r.value for r in spark.read.text(str(tmp_path / "out/main_graph")).where("value like 'L%'").collect()}
    assert len(links) == 2 and all(x.split("\t")[5] == "0M" for x in links)
    full = spark.read.text(str(tmp_path / "out/full_graph"))
    assert full.where("value like 'S%'").count() == 25 and full.where("value like 'L%'").count() == arcs.count()


def test_boundary_vertices_join_their_chain(spark):
    chains = spark.createDataFrame([(0, 8, 4)], "begin long, end long, node long")
    bubbles = spark.createDataFrame([(0, 6, 2, True, False), (0, 6, 4, True, True), (3, 8, 6, False, True), (3, 9, 7, True, True)], "s long, t long, v long, first boolean, last boolean")
    assert {tuple(r) for r in drivers.attach_bounds(chains, bubbles).collect()} == {(0, 8, 4), (0, 8, 2), (0, 8, 6)}


def _reads(rng, targets, pairs):
    turn = str.maketrans("ACGT", "TGCA")
    out = []
    for u, v in pairs:
        both = []
        for x in (u, v):
            at = rng.randrange(len(targets[x]) - 150)
            r = targets[x][at : at + 150]
            back = rng.random() < 0.5
            both.append((r.translate(turn)[::-1] if back else r, not back))
        out.append(both)
    return out


def test_files_to_contacts(spark, tmp_path):
    rng = random.Random(5)
    targets = {f"t{i}": "".join(rng.choice("ACGT") for _ in range(1500)) for i in range(6)}
    (tmp_path / "t.fa").write_text("".join(f">{n} of the test\n{s}\n" for n, s in targets.items()))
    pairs = [(f"t{rng.randrange(6)}", f"t{rng.randrange(6)}") for _ in range(120)]
    reads = _reads(rng, targets, pairs)
    for m in (0, 1):
        (tmp_path / f"r{m}.fq").write_text("".join(f"@r{i}\n{x[m][0]}\n+\n{'I' * 150}\n" for i, x in enumerate(reads)))
    (tmp_path / "groups.csv").write_text("node,type\n0,1\n1,2\n")
    drivers.map_files(spark, str(tmp_path / "t.fa"), str(tmp_path / "r0.fq"), str(tmp_path / "r1.fq"), str(tmp_path / "out"), k=21, groups=str(tmp_path / "groups.csv"))
    want = {}
    for (u, v), (a, b) in zip(pairs, reads, strict=True):
        i, j = sorted((int(u[1]), int(v[1])), reverse=True)
        if i != j and {i, j} != {0, 1}:
            want.setdefault((i, j), [0, 0])[a[1] != b[1]] += 1
    got = {}
    for r in spark.read.text(str(tmp_path / "out/contacts")).collect():
        i, j, fwd, bwd = map(int, r.value.split()[:4])
        got[i, j] = [fwd, bwd]
    assert got == want
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/units")).collect()) == [f"{i}\tt{i}" for i in range(6)]


def test_streamed_contacts_add_up(spark, tmp_path):
    from threadloom.streaming import ingest

    rows = [(i, i % 4, i % 3 == 0, i % 5, i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "read_idx long, target1 long, same1 boolean, target2 long, same2 boolean")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.contact_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = {}
    for _, u, a, v, b in rows:
        if u != v:
            want.setdefault((max(u, v), min(u, v)), [0, 0])[a != b] += 1
    assert {(r.i, r.j): [r.fwd, r.bwd] for r in ingest.total_contacts(spark, str(tmp_path / "out")).collect()} == want


def test_windowed_counts(spark):
    from threadloom.streaming import ingest

    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((str(r.window.start), r.event_type, r.n) for r in ingest.windowed_counts(df).collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1)]

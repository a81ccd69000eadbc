"""The pipeline's stages against brute force on their own inputs."""

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from threadloom.llm import bpe, mixing, queries, quality
from threadloom.llm.common import table, words_of

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = table(spark, DATA, "documents"), []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        seen.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = seen[-1][1]
    assert all(a.columns == b.columns for a, b in seen[:-1])

    before, after = seen[0]
    judged = quality.judge_quality(before, table(spark, DATA, "labels"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged.where("predicted = 1").collect()}

    before, after = seen[1]
    sets = {}
    for r in before.collect():
        w = words_of(r.text)
        sets[r.doc_id] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in after.collect()} == {i for i in sets if find(i) == i}

    before, after = ({r.doc_id: r for r in x.collect()} for x in seen[2])
    assert before.keys() == after.keys()
    least = {}
    for i in sorted(before):
        w = words_of(before[i].text)
        for p in range(len(w) - 49):
            least.setdefault(tuple(w[p : p + 50]), i)
    for i in before:
        w = words_of(before[i].text)
        gone = {q for p in range(len(w) - 49) if least[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        assert after[i].text == (" ".join(x for q, x in enumerate(w) if q not in gone) if gone else before[i].text)
        assert after[i].n_chars == (len(after[i].text) if gone else before[i].n_chars)

    before, after = seen[3]
    want = {r.doc_id: r.mix_copies for r in mixing.mix_sources(before).collect() if r.mix_copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want

    before, after = seen[4]
    know = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY)), special_tokens={})
    n = {r.doc_id: len(know.encode_ordinary(r.text)) for r in before.select("doc_id", "text").distinct().collect()}
    assert after.count() == before.count() and all(r.n_tokens == n[r.doc_id] for r in after.collect())
    assert corpus_pipeline.run(spark, DATA).agg(F.count("*")).first()[0] == after.count()


def _brute_mix(rows):
    """Copies by source of rows (doc_id, source, text): only what the contract fixes, sums near targets and at most two copies."""
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, total = set(order), {}, 1.5 * sum(sizes.values())
    while left:
        share = (total - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if share * weight[s] >= 2 * sizes[s]}
        for s in full or left:
            target[s] = 2 * sizes[s] if full else share * weight[s]
        left -= full or left
    return sizes, target


def test_mix_stage_by_brute_force(spark):
    docs = table(spark, DATA, "documents")
    before = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    sizes, target = _brute_mix(before)
    taken, times = {}, {}
    for r in corpus_pipeline.mix(spark, docs, DATA).collect():
        taken[r.source] = taken.get(r.source, 0) + len(words_of(r.text))
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    longest = {s: max(len(words_of(t)) for _, x, t in before if x == s) for s in sizes}
    assert max(times.values()) <= 2
    for s in sizes:
        assert abs(taken.get(s, 0) - target[s]) <= max(0.02 * target[s], min(longest[s], 0.5 * target[s]))


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and a column whose name clashes."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    words = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, None, None, None, None, None), (2, "", "en", "a", 0, 0.5), (3, " \t\n", "en", "a", 3, 0.5), (4, words + ".", "en", "b", 500, 0.5), (4, words + ".", "en", "b", 500, 0.5),
        (5, "before " * 60 + words + ".", "en", "b", None, None), (None, "no id at all", None, "c", 12, 1.0), (6, "long " * 200_000, "en", "c", 10**6, 0.1), (7, words + ".", "de", None, 500, 0.5), (8, "x" * 500_000, "en", "a", 500_000, 0.5),
    ]
    docs = spark.createDataFrame(rows, schema)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, DATA)
        got = out.collect()
        assert step(spark, docs.limit(0), DATA).count() == 0, name
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert sorted((r.doc_id or 0, r.text and r.text[:3]) for r in got) == sorted([(0, "no "), (1, None), (2, ""), (3, " \t\n"), (4, "w0 "), (6, "lon"), (8, "xxx")], key=lambda x: (x[0], x[1] or "")) and sum(r.doc_id == 4 for r in got) == 1
        if name == "repeated_passages":
            left = {r.doc_id: r.text for r in got}
            assert left[5] == ("before " * 60).strip() and left[1] is None and left[7] == "" and left[4] == words + "." and len(left[6]) == 10**6
        if name == "tokens":
            assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}


def test_tables_on_the_way_go(spark):
    from pathlib import Path

    from threadloom.plans.staging import folder

    here = lambda: {p.name for p in Path(folder(spark).removeprefix("file:")).iterdir() if p.suffix != ".crc"}
    before = here()
    got = corpus_pipeline.run(spark, DATA)
    assert [x.rsplit("-", 1)[0] for x in here() - before] == ["pipeline-tokens"] and got.count() > 0


def test_workers_keep_nothing_for_earlier_stages(spark):
    """Workers outlive a stage: what one remembers of tokens is gone once it has run a task of another stage."""
    import numpy as np

    from threadloom.llm.trees import fit_trees

    def live(batches):
        import gc

        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"n": [sum(type(x).__name__ == "BytePairCodec" for x in gc.get_objects())]})

    count = lambda: spark.range(0, 64, 1, 64).mapInPandas(live, "n long").agg(F.sum("n")).first()[0]
    docs = table(spark, DATA, "documents").repartition(64)
    assert corpus_pipeline.tokens(spark, docs, DATA).agg(F.sum("n_tokens")).first()[0] > 0 and count() > 0
    model = fit_trees(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    assert quality.score_quality(docs, model).agg(F.min("score")).first()[0] == 0.5 and count() == 0


def test_few_long_texts_go_to_a_worker_at_once(spark):
    from threadloom.llm.common import bounded_batches

    def size(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"mb": [pdf["text"].str.len().sum() / 1e6]})

    long = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 1000000)").alias("text"))
    got = bounded_batches(long).mapInPandas(size, "mb double").agg(F.sum("mb"), F.max("mb")).first()
    assert got[0] == 40 and got[1] < 12

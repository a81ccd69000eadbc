"""op1's tables on the way stay few files, however many partitions a shuffle has."""

from threadloom.llm import toxicity


def test_tables_of_the_sample_are_few_files(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} {'vile' if i % 3 == 0 else 'kind'} letters {i % 5} again") for i in range(300)], "doc_id long, text string").repartition(90)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), i % 2) for i in range(300)], "doc_id long, toxic int, quality int")
    files, stage = {}, toxicity.stage

    def noted(df, name):
        out = stage(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(toxicity, "stage", noted)
    # as where a cluster sets many shuffle partitions, or deals what has a key to many
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *cols, f=type(docs).repartition: f(self, max(n, 90) if cols and isinstance(n, int) else n, *cols))
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 90)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chain = toxicity.train_toxicity(docs, labels)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert set(files) == {"toxic-rows", "toxic-counts"} and max(files.values()) <= toxicity.PARTS
    got = toxicity.score_toxicity(docs, chain).collect()
    assert len(got) == 300 and all(r.toxic == (r.doc_id % 3 == 0) for r in got)

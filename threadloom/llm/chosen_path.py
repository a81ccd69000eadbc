"""N-gram Jaccard join by chosen paths (operator 8): documents whose sets of five-word shingles reach Jaccard 0.8.

Documents with the same set are one node, so copies are never paired. In each run a node samples BRANCH tokens of its
set, those with the least hashes of that run, and goes to the bucket of each; so sets that share most tokens meet and
others part. A bucket of at most limit nodes is compared by brute force; in larger ones each node goes on to the buckets
of BRANCH tokens sampled by the next level's hash, and so forth. A pair at the threshold t fails to share a sampled token
with odds (1-t)^2 (2-t) / 2, and runs repeat until such a pair, split at every level, is met with the target recall.

Brute force first compares the samples of all runs and levels (a pair at the threshold fails at odds of a few in a
hundred thousand) and hands on links that hold a bucket's groups together. Groups of nodes thus linked are then checked
exactly, all pairs within a group in cells of bounded size, where links are counted and not written out one by one; so
within a group no link between different texts is lost. What is left at the last level is handed on as a group unseen.

Buckets with more than a thousandth of all rows, a thousand at most, are joined by broadcast, others by shuffle.

Words are WORD, as they are. A text of one to four words has all of them as its one shingle; a null, empty or blank text
has none and links to nothing. Repeated rows are copies. A null id orders after all others. Extra columns are ignored or
kept, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.components import connected

from .common import WordHashes, bounded_batches, mix64, stage, tidy, window_hashes, words_of

WIDTH, THRESHOLD, RECALL, LEVELS, BRANCH, LIMIT, CELL = 5, 0.8, 0.999, 4, 2, 256, 384
#: How far below the threshold the share of equal samples may be.
SLACK = 0.4
HOT_BUCKETS = 1000
BROADCAST_ROWS = 300_000


def runs_for(recall: float, threshold: float, levels: int) -> int:
    """Runs that meet a pair at the threshold with the recall though every level splits its buckets.

    Of the union's tokens in order of hash, one that both sets have comes before either has two of its own.
    """
    d = 1 - threshold
    met = (1 - d * d * (1 + d) / 2) ** levels
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words, or of all words where there are fewer."""
    words = words_of(text)
    return np.unique(window_hashes(hashes(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def set_digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def least_two(tokens: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The two least hashes of a set under each function; of one token, the same twice."""
    low = np.full((len(times), 2), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), 4096):
        h = np.concatenate([tokens[at : at + 4096] * times + plus, low], axis=1) if at else tokens * times + plus if len(tokens) <= 4096 else tokens[:4096] * times + plus
        low[:, 0] = h.min(1)
        h[h == low[:, :1]] = np.iinfo(np.uint64).max
        low[:, 1] = h.min(1)
    if len(tokens) == 1:
        low[:, 1] = low[:, 0]
    return low


def _sketched(docs: DataFrame, key: str, text: str, runs: int, levels: int) -> DataFrame:
    """key, h (hash of the text), node (digest of the set, null if empty) and sampled: BRANCH hashes for each run and level."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, k = WordHashes(), runs * levels
        seeds = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        times, plus = (seeds[:k] | np.uint64(1))[:, None], seeds[k:][:, None]
        for pdf in batches:
            rows = []
            for t in pdf["_t"]:
                tokens = shingles(t, hashes)
                rows.append((set_digest(tokens), least_two(tokens, times, plus).reshape(-1).view(np.int64)) if len(tokens) else (None, None))
            out = pd.DataFrame(rows, columns=["node", "sampled"])
            out.insert(0, "key", pdf["_k"].to_numpy())
            out.insert(1, "h", pdf["_h"].to_numpy())
            yield out

    return bounded_batches(docs).select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.xxhash64(text).alias("_h")).mapInPandas(tidy(run), f"key {kind}, h long, node binary, sampled array<long>")


def _roots(alike: np.ndarray) -> np.ndarray:
    """The least place that each place is joined to by a symmetric matrix of links."""
    root = np.arange(len(alike))
    while True:
        new = np.where(alike, root[None, :], len(root)).min(1, initial=len(root))
        new = np.minimum(root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _bucket_links(buckets: DataFrame, least_share: float) -> DataFrame:
    """Links that hold together what is alike by sample, from (nodes, samples) of a bucket each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [], []
            for nodes, samples in zip(pdf["nodes"], pdf["samples"], strict=True):
                x, y = (np.stack([s[i::BRANCH] for s in samples]) for i in range(BRANCH))
                both = np.zeros((len(nodes), len(nodes)), np.int32)
                for i in range(x.shape[1]):
                    for p, q in ((x, x), (y, y), (x, y), (y, x)):
                        both += p[:, None, i] == q[None, :, i]
                root = _roots(both >= least_share * BRANCH * x.shape[1])
                for i in np.nonzero(root != np.arange(len(root)))[0]:
                    a.append(nodes[i])
                    b.append(nodes[root[i]])
            yield pd.DataFrame({"a": a, "b": b})

    return buckets.mapInPandas(tidy(run), "a binary, b binary")


def _with_counts(now: DataFrame) -> DataFrame:
    """node, run, p, n (nodes of the bucket), least, for buckets of two nodes or more; a bucket with very many rows is not dealt to one task."""
    counts = stage(now.groupBy("p").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "path-counts")
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    most = max((total or 0) / HOT_BUCKETS, LIMIT)
    if (largest or 0) <= most:
        return stage(now.join(counts, "p"), "path-level")
    hot = F.broadcast(counts.where(F.col("n") > most))
    rest = now.join(hot.select("p"), "p", "left_anti").join(counts.where(F.col("n") <= most), "p")
    return stage(now.join(hot, "p").unionByName(rest), "path-level")


def candidate_links(nodes: DataFrame, runs: int, levels: int = LEVELS, limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) among nodes (node, sampled) that chosen paths bring together."""

    def sampled(level: int) -> Column:
        return F.array_distinct(F.slice("sampled", (F.col("run") * levels + level) * BRANCH + 1, BRANCH))

    now = nodes.select("node", "sampled", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).select("node", "run", F.explode(sampled(0)).alias("t"))
    now = now.select("node", "run", F.xxhash64("run", "t").alias("p"))
    rows, rest = None, None
    for level in range(levels):
        met = _with_counts(now)
        small = met.where(F.col("n") <= limit).select("p", "node")
        rows = small if rows is None else rows.union(small)
        large = met.where(F.col("n") > limit)
        if level == levels - 1:
            rest = large.where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        elif large.limit(1).count() == 0:
            rest = rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
            break
        else:  # nodes of large buckets take their next tokens along
            now = large.select("node", "run", "p").join(nodes.select("node", "sampled"), "node").select("node", "run", "p", F.explode(sampled(level + 1)).alias("t"))
            now = stage(now.select("node", "run", F.xxhash64("p", "t").alias("p")), "path-next")
    buckets = rows.join(nodes.select("node", "sampled"), "node").groupBy("p").agg(F.collect_list("node").alias("nodes"), F.collect_list("sampled").alias("samples"))
    return _bucket_links(buckets.select("nodes", "samples"), threshold - SLACK).union(rest).distinct()


def cell_links(ids: list[bytes], sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Per set, the weight of the sets linked to it and the least place joined to it; left: links go between it and the rest only."""
    m, n = len(ids), np.array([len(s) for s in sets])
    if m <= 8:
        both = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(code)[code] > 1
        owner = np.repeat(np.arange(m), n)[shared]
        code = np.unique(code[shared], return_inverse=True)[1]
        both = np.zeros((m, m), dtype=np.float32)
        by = np.argsort(code, kind="stable")
        owner, code = owner[by], code[by]
        step = 8192
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
            a, b = np.searchsorted(code, [at, at + step])
            x = np.zeros((m, step), dtype=np.float32)
            x[owner[a:b], code[a:b] - at] = 1
            both += x @ x.T
    alike = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6
    np.fill_diagonal(alike, False)
    if left is not None:
        alike &= left[:, None] != left[None, :]
    return alike @ weights, _roots(alike)


def _checked(texts: DataFrame, threshold: float) -> DataFrame:
    """node, links, root of each cell, from rows (text, node, grp, blocks, block, weight)."""

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            sets = [shingles(t, hashes) for t in pdf["text"]]
            right = np.array([set_digest(s) == d for s, d in zip(sets, pdf["node"], strict=True)], dtype=bool)  # an id may repeat with another text
            yield pdf.drop(columns="text").assign(tokens=[s.tobytes() for s in sets])[right]

    rows = texts.mapInPandas(tidy(sets_of), "node binary, grp binary, blocks int, block int, weight long, tokens binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = rows.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    cells = cells.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def done() -> pd.DataFrame | None:
            ids = [h[0] for h in held]
            if len(ids) < 2:
                return None
            sets, weights = [np.frombuffer(h[1], np.uint64) for h in held], np.array([h[2] for h in held], dtype=np.int64)
            left = np.array([h[3] == at[1] for h in held]) if at[1] != at[2] else None
            links, root = cell_links(ids, sets, weights, left, threshold)
            used = np.nonzero(links)[0]
            return pd.DataFrame({"node": [ids[i] for i in used], "links": links[used], "root": [ids[root[i]] for i in used], "alone": [held[0][4] == 1] * len(used)}) if len(used) else None

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key = (r.grp, r.i, r.j)
                if key != at:
                    if (out := done() if held else None) is not None:
                        yield out
                    at, held = key, []
                if not held or held[-1][0] != r.node:  # a repeated row comes next to its like
                    held.append((r.node, r.tokens, r.weight, r.block, r.blocks))
        if (out := done() if held else None) is not None:
            yield out

    return cells.select("node", "grp", "blocks", "block", "weight", "tokens", "i", "j").mapInPandas(tidy(check), "node binary, links long, root binary, alone boolean")


def _classes(docs: DataFrame, key: str, text: str, threshold: float, recall: float, levels: int) -> DataFrame:
    """key, h (hash of the text), class_id, copy_id, n_copies, n_links."""
    runs = runs_for(recall, threshold, levels)
    rows = stage(_sketched(docs, key, text, runs, levels), "path-rows")
    nodes = stage(rows.where("node is not null").groupBy("node").agg(F.min("key").alias("copy_id"), F.count("*").alias("n_copies"), F.first("sampled").alias("sampled")), "path-nodes")
    links = stage(candidate_links(nodes, runs, levels, threshold=threshold), "path-links")
    groups = connected(links).withColumnRenamed("root", "grp").withColumnRenamed("id", "node")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "grp").join(nodes.select("node", "copy_id", F.col("n_copies").alias("weight")), "node")
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    members = stage(members.select("copy_id", "node", "grp", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "weight"), "path-members")
    by_id = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(by_id, F.col("_k").eqNullSafe(F.col("copy_id"))).select("text", "node", "grp", "blocks", "block", "weight")
    found = stage(_checked(texts, threshold), "path-checked")
    across = found.where("not alone").select(F.col("node").alias("a"), F.col("root").alias("b"))
    classes = found.where("alone").select("node", "root")
    if across.limit(1).count():
        classes = classes.union(connected(across).select(F.col("id").alias("node"), "root"))
    named = nodes.select("node", "copy_id", "n_copies").join(classes.distinct(), "node", "left").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("copy_id").alias("least"))
    named = stage(named.join(least, "root", "left").select("node", F.coalesce("least", "copy_id").alias("class_id"), "copy_id", "n_copies", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")), "path-classes")
    out = rows.select("key", "h", "node").join(named, "node", "left")
    return out.select("key", "h", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("copy_id", "key").alias("copy_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> DataFrame:
    """Per row: key, class_id (least id of the rows joined to it by links), copy_id (least id with its set), n_copies, n_links (rows linked to it)."""
    return _classes(docs, key, text, threshold, recall, levels).drop("h").withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> DataFrame:
    """docs without the rows of a class but for that with its least id, and without rows that repeat it; columns stay. Null ids stay.

    Rows that repeat an id with another text are judged each by its text.
    """
    judged = stage(_classes(docs, key, text, threshold, recall, levels), "path-judged")
    gone = stage(judged.where(F.col("key") != F.col("class_id")).select(F.col("key").alias("_gone"), F.col("h").alias("_hash")).distinct(), "path-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = docs.join(gone, (F.col(key) == F.col("_gone")) & (F.xxhash64(text) == F.col("_hash")), "left_anti")
    again = judged.where(F.col("key").isNotNull()).groupBy("key").count().where("count > 1").limit(1).count()
    return (kept.where(F.col(key).isNotNull()).dropDuplicates([key, text]).unionByName(kept.where(F.col(key).isNull())) if again else kept).select(*docs.columns)

"""Exact top-k search by inner product of whole numbers (operator 4).

Rows are packed, where they lie, into blocks of 256 with their forward index (a matrix) and the greatest and least value
of each term. Blocks are gathered into cells of about 8,192 rows, queries into cells of about 2,048, and each pair of
cells is one group of a cogrouped map: a query set against all rows, in blocks. In it, each query visits blocks in the
order of the greatest score that their terms allow, the sum over terms of weight times maximum (or minimum, for negative
weights), and stops when that is below its k-th best. Only k rows a query and cell leave a task; the best k of these are
the result.

Components are floor(scale * x) as whole numbers, held to 62 bits; products are taken in the narrowest type that holds
them exactly, and a score beyond 64 bits is the end of their range. Rows
that are null, or that hold a null or a component that is not finite, take no part; a row that is shorter than another
counts as padded with zeros; an empty vector scores 0. Every row but those with the query's own id is a candidate, a
repeated row each time. Queries that repeat an id with other components are answered each by itself, equal ones once. With
fewer candidates than k all are returned. Extra columns are ignored, an empty table gives an empty result, and a null id
takes no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

BLOCK, CANDIDATES, QUERIES = 256, 8192, 2048
_PACKED = "n int, width int, ids binary, hashes binary, data binary, own int"
NONE = np.iinfo(np.int64).min


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    got = a.astype(object) @ b.astype(object).T
    return np.clip(got, -(2**63), 2**63 - 1).astype(np.int64)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, held at the ends of the type's range."""
    most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    high, low = (b > 0) & (a > most - np.maximum(b, 0)), (b < 0) & (a < least - np.minimum(b, 0))
    return np.where(high, most, np.where(low, least, a + np.where(high | low, 0, b)))


def components(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """_k, _v (whole numbers) and _h (their hash) of the rows that take part."""
    bad = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("_x", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long"))
    found = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("_k"), F.col(vector).cast("array<double>").alias("_x"))
    return found.where(~bad).select("_k", whole.alias("_v")).withColumn("_h", F.xxhash64("_v"))


def pack(rows: DataFrame, size: int, cells: int) -> DataFrame:
    """Blocks of at most size of the rows of components(), in the order of the table, dealt out over cells in turn."""
    step = next(x for x in itertools.count(7919) if math.gcd(x, cells) == 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        ids, hashes, vectors = [], [], []

        def block() -> pd.DataFrame:
            nonlocal turn
            width = max(map(len, vectors))
            data = np.zeros((len(vectors), width), dtype=np.int64)
            for i, v in enumerate(vectors):
                data[i, : len(v)] = v
            kind = np.int16 if np.abs(data).max(initial=0) < 2**15 else np.int64
            turn += 1
            out = pd.DataFrame({"n": [len(ids)], "width": [width], "ids": [np.array(ids, np.int64).tobytes()], "hashes": [np.array(hashes, np.int64).tobytes()], "data": [data.astype(kind).tobytes()], "own": [turn * step % cells]})
            for x in (ids, hashes, vectors):
                x.clear()
            return out

        for pdf in batches:
            for i, h, v in zip(pdf["_k"], pdf["_h"], pdf["_v"], strict=True):
                ids.append(i)
                hashes.append(h)
                vectors.append(v)
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()

    return rows.select("_k", "_h", "_v").mapInPandas(run, _PACKED)


def _matrix(n: int, width: int, data: bytes, to: int) -> np.ndarray:
    x = np.frombuffer(data, np.int16 if len(data) == 2 * n * width else np.int64).reshape(n, width)
    return np.pad(x.astype(np.int64), ((0, 0), (0, to - width)))


def search_cell(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and scores of each query (unused places: score NONE), best first; below a query's floor some may lack."""
    none = NONE
    floor = np.full(len(queries), none) if floor is None else floor
    top = np.full((len(queries), k), none)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    most, least = (np.stack([f(x) for _, x in blocks]) for f in (lambda x: x.max(0), lambda x: x.min(0)))
    bounds = _sum(_product(np.maximum(queries, 0), most), _product(np.minimum(queries, 0), least))
    order = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(len(queries))
    for step in range(len(blocks)):
        at = order[active, step]
        go = bounds[active, at] >= np.maximum(top[active, -1], floor[active])  # an equal score may still win by its id
        active, at = active[go], at[go]
        if not len(active):
            break
        by = np.argsort(at, kind="stable")
        for part in np.split(by, np.nonzero(np.diff(at[by]))[0] + 1):
            q = active[part]
            ids, x = blocks[at[part[0]]]
            scores = _product(queries[q], x)
            scores[query_ids[q][:, None] == ids[None, :]] = none
            better = (scores >= np.maximum(top[q, -1], floor[q])[:, None]).any(1) & (scores > none).any(1)
            q, scores = q[better], scores[better]
            if not len(q):
                continue
            if scores.shape[1] > 4 * k:  # all that reach the k-th best of this block can matter
                kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                keep = (scores >= np.maximum(kth, top[q, -1])[:, None]).any(0)
                scores, ids = scores[:, keep], ids[keep]
            s = np.concatenate([top[q], scores], axis=1)
            w = np.concatenate([who[q], np.broadcast_to(ids, scores.shape)], axis=1)
            first = _best(s, w, k)
            top[q], who[q] = np.take_along_axis(s, first, 1), np.take_along_axis(w, first, 1)
    return who, top


def _best(s: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, greatest first, then by id; ~ reverses the order of whole numbers without overflow."""
    by_id = np.argsort(w, axis=1, kind="stable")
    by_score = np.argsort(~np.take_along_axis(s, by_id, 1), axis=1, kind="stable")
    return np.take_along_axis(by_id, by_score, 1)[:, :k]


def _opened(b: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids, hashes and components of packed queries, by id and hash, and the scores that a first pass found for them."""
    told, b = b[b["n"] < 0], b[b["n"] >= 0]
    ids, hashes = (np.concatenate([np.frombuffer(x, np.int64) for x in b[c]]) for c in ("ids", "hashes"))
    order = np.lexsort((hashes, ids))
    queries = np.concatenate([_matrix(r.n, r.width, r.data, width) for r in b.itertuples()])[order]
    return ids[order], hashes[order], queries, np.frombuffer(told["data"].iloc[0], np.int64) if len(told) else None


def _held(a: pd.DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(r.ids, np.int64), _matrix(r.n, r.width, r.data, width)) for r in a.itertuples()]


def top_k(rows: DataFrame, wanted: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, for the rows that wanted selects as queries."""
    n = rows.count()
    cells, groups = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(rows.where(wanted).count() / QUERIES))
    blocks = stage(pack(components(rows, key, vector, scale), BLOCK, cells), "topk-blocks")
    asked = stage(pack(components(rows.where(wanted), key, vector, scale).dropDuplicates(["_k", "_v"]), BLOCK, groups), "topk-queries")

    def first(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The k-th best scores of a cell of queries in one cell of candidates."""
        if not len(a) or not len(b):
            return pd.DataFrame({c.split(" ")[0]: [] for c in _PACKED.split(", ")})
        width = int(max(a["width"].max(), b["width"].max()))
        ids, _, queries, _ = _opened(b, width)
        _, top = search_cell(ids, queries, _held(a, width), k)
        return pd.DataFrame({"n": [-1], "width": [0], "ids": [b""], "hashes": [b""], "data": [top[:, -1].tobytes()], "own": [b["own"].iloc[0]]})

    if cells > 1:
        one = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where(F.col("own") == F.col("g") % cells)
        seeds = one.groupBy("g").cogroup(asked.withColumn("g", F.col("own")).groupBy("g")).applyInPandas(first, _PACKED)
        asked = asked.union(stage(seeds, "topk-seeds"))
    # each cell of candidates meets each cell of queries
    left = blocks.withColumn("c", F.col("own")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("g", F.col("own")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not (b["n"] >= 0).any():
            return pd.DataFrame({"query_id": [], "hash": [], "c": [], "vec_id": [], "score": []}).astype("int64")
        width = int(max(a["width"].max(), b["width"].max()))
        ids, hashes, queries, floor = _opened(b, width)
        who, top = search_cell(ids, queries, _held(a, width), k, floor)
        used = top > NONE if floor is None else (top > NONE) & (top >= floor[:, None])
        return pd.DataFrame({"query_id": np.repeat(ids, used.sum(1)), "hash": np.repeat(hashes, used.sum(1)), "c": a["c"].iloc[0], "vec_id": who[used], "score": top[used]})

    found = left.groupBy("c", "g").cogroup(right.groupBy("c", "g")).applyInPandas(meet, "query_id long, hash long, c long, vec_id long, score long")
    best = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), F.col("vec_id").alias("v")))), 1, k)
    run = math.isqrt(cells)
    if run > 1:
        part = found.groupBy("query_id", "hash", F.floor(F.col("c") / run).alias("c")).agg(best.alias("best"))
        found = part.select("query_id", "hash", F.explode("best").alias("x")).select("query_id", "hash", F.bitwise_not("x.s").alias("score"), F.col("x.v").alias("vec_id"))
    out = found.groupBy("query_id", "hash").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), F.bitwise_not("x.s").alias("score"))

"""Toxicity (operator 1): a chain of linear classifiers, one for each category, in a fixed order.

Features are a text's words in lower case and their first four to eight letters, hashed; their values grow with the root
of their share of the text's words. Training keeps those that tell the categories apart best. A later category's
classifier also has the probabilities of the earlier categories. In training these come from classifiers that never saw
the row's fold, neither in fitting nor in choosing features, and copies and near copies share a fold; so later classifiers
learn from earlier ones as they will meet them. Scoring uses classifiers fitted on all rows.

Trained on at most max_rows labelled documents, those with the smallest hash of their id. Features are counted and chosen
in Spark; the driver gets a sketch of 480 bytes a row and the chosen features only. Every document is scored, over its
whole text. Null and empty texts have no features and get each category's probability by its intercept. A category
with one class only has its smoothed share as its probability everywhere. Null labels are left out; of several labels of
an id the greatest count. Repeated rows are scored each, extra columns stay, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, stage, tidy

MAX_ROWS = 8_000
FEATURES = 768
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.5
FOLDS = 5
#: Partitions of the sample, whose features are counted, and most files of these counts: each file of a table starts
#: processes of its own (chmod), which for a moment count as large as the JVM that starts them.
PARTS = 32
#: Categories from the columns of labels: toxic text of low quality, toxic text otherwise fine, any toxic text.
CATEGORIES = {"toxic_junk": "toxic = 1 and coalesce(quality, 1) = 0", "toxic_prose": "toxic = 1 and coalesce(quality, 1) = 1", "toxic": "toxic = 1"}
_SPACE = 1 << 22
_LETTERS = re.compile(r"[^\W\d_]+")


class WordFeatures:
    """Hashes of a text's features; what a word gives is remembered up to a number of words."""

    def __init__(self, chosen: dict[int, int] | None = None, limit: int = 150_000) -> None:
        self.chosen, self.limit = chosen, limit
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.known) > self.limit:
            self.known.clear()
        names = [f"w:{word}", *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]
        found = [zlib.crc32(x.encode()) % _SPACE for x in names]
        got = tuple(found) if self.chosen is None else tuple(self.chosen[x] for x in found if x in self.chosen)
        self.known[word] = got
        return got

    def __call__(self, text: str | None) -> dict[int, float]:
        """Each feature with its value."""
        words = _LETTERS.findall(text.lower()) if text else []
        times: dict[int, int] = {}
        known = self.known
        for w, n in Counter(words).items():
            got = known.get(w)
            for x in self._of(w) if got is None else got:
                times[x] = times.get(x, 0) + n
        return {x: min(4.0, math.sqrt(200 * n / len(words))) for x, n in times.items()}


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 200) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression by accelerated gradient steps."""
    n = len(y)
    share = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    w[-1] = share
    if n == 0 or y.min() == y.max():
        return w
    x = np.concatenate([x, np.ones((n, 1), np.float32)], axis=1)
    penalty = np.full(x.shape[1], ridge, np.float32)
    penalty[-1] = 0
    # the curvature is at most a quarter of the greatest eigenvalue; a few power steps find it
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.26 * float(np.linalg.norm(x.T @ (x @ v))) + ridge)
    old = w.copy()
    for t in range(steps):
        ahead = w + (t / (t + 3)) * (w - old)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        old, w = w, (ahead - rate * (x.T @ (p - y) + penalty * ahead)).astype(np.float32)
    return w


def _share(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-log_odds))


@dataclass
class Chain:
    names: list[str]
    chosen: dict[int, int]  # feature hash to column
    weights: list[np.ndarray]  # each: columns, then earlier categories' probabilities, then the intercept

    def log_odds(self, present: list[dict[int, float]]) -> np.ndarray:
        """Rows x categories, from the values of chosen columns."""
        k, out = len(self.chosen), np.zeros((len(present), len(self.names)))
        for j, w in enumerate(self.weights):
            own = np.array([w[list(p)] @ np.fromiter(p.values(), np.float32, len(p)) if p else 0.0 for p in present], dtype=np.float64)
            out[:, j] = np.clip(own + _share(out[:, :j]) @ w[k : k + j] + w[-1], -30, 30)
        return out


def choose_features(present: list[np.ndarray], y: np.ndarray, most: int) -> dict[int, int]:
    """The features with the greatest chi-square statistic against any of the categories, in at least three rows."""
    if not len(present):
        return {}
    flat = np.concatenate(present)
    names, code = np.unique(flat, return_inverse=True)
    rows = np.repeat(np.arange(len(present)), [len(p) for p in present])
    n, total = np.bincount(code, minlength=len(names)).astype(float), len(present)
    score = np.zeros(len(names))
    for j in range(y.shape[1]):
        with_, positive = np.bincount(code, y[rows, j], minlength=len(names)), y[:, j].sum()
        expected = n * positive / total
        spread = expected * (1 - positive / total) * (1 - n / total)
        score = np.maximum(score, np.where(spread > 0, (with_ - expected) ** 2 / np.maximum(spread, 1e-12), 0))
    score[n < 3] = 0
    best = np.argsort(-score, kind="stable")[:most]
    return {int(names[i]): k for k, i in enumerate(b for b in best if score[b] > 0)}


BANDS, WIDTH = 12, 5


def sketch(features: np.ndarray) -> np.ndarray:
    """The least hash of a row's features under each of BANDS x WIDTH functions."""
    seeds = mix64(np.arange(1, 2 * BANDS * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    times, plus = (seeds[: len(seeds) // 2] | np.uint64(1))[:, None], seeds[len(seeds) // 2 :][:, None]
    out = np.full(BANDS * WIDTH, 2**44, np.uint64)
    for at in range(0, len(features), 4096):
        np.minimum(out, ((features[at : at + 4096].astype(np.uint64) * times + plus) >> np.uint64(20)).min(1), out=out)
    return out


def copy_groups(sketches: np.ndarray, threshold: float = 0.7) -> np.ndarray:
    """A number for each row, the same for rows whose sketches agree in the threshold's share with the first row of a common band."""
    n = len(sketches)
    group = np.arange(n)

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for band in range(0, BANDS * WIDTH, WIDTH):
        first: dict[bytes, int] = {}
        for i in range(n):
            j = first.setdefault(sketches[i, band : band + WIDTH].tobytes(), i)
            a, b = root(i), root(j)
            if a != b and (sketches[i] == sketches[j]).mean() >= threshold:
                group[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], dtype=np.int64)


def fold_of(groups: np.ndarray, folds: int) -> np.ndarray:
    """Groups, the largest first, to the fold with the fewest rows so far."""
    names, code, n = np.unique(groups, return_inverse=True, return_counts=True)
    size, of = np.zeros(folds, np.int64), np.zeros(len(names), np.int64)
    for g in np.argsort(-n, kind="stable"):
        of[g] = size.argmin()
        size[of[g]] += n[g]
    return of[code]


def _columns(present: list[np.ndarray], values: list[np.ndarray], chosen: dict[int, int]) -> np.ndarray:
    x = np.zeros((len(present), len(chosen)), np.float32)
    for i, (p, v) in enumerate(zip(present, values, strict=True)):
        for f, value in zip(p.tolist(), v.tolist(), strict=True):
            if (c := chosen.get(f)) is not None:
                x[i, c] = value
    return x


def out_of_fold(present: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, j: int, earlier: np.ndarray, fold: np.ndarray, most: int) -> np.ndarray:
    """Probabilities of category j, each from a classifier that is fitted, with the features it chooses, on the other folds."""
    told = np.zeros((len(present), 1), np.float32)
    for f in np.unique(fold):
        own, rest = np.nonzero(fold == f)[0], np.nonzero(fold != f)[0]
        chosen = choose_features([present[i] for i in rest], y[rest], most)
        x = np.concatenate([_columns(present, values, chosen), earlier], axis=1)
        w = fit_linear(x[rest], y[rest, j])
        told[own, 0] = _share(np.clip(x[own] @ w[:-1] + w[-1], -30, 30))
    return told


def fit_chain(present: list[np.ndarray], y: np.ndarray, names: list[str], most: int = FEATURES, folds: int = FOLDS, values: list[np.ndarray] | None = None, fold: np.ndarray | None = None) -> Chain:
    """From rows of distinct features (with values, else 1 each), of labels (rows x categories) and of folds (else by copies)."""
    values = [np.ones(len(p), np.float32) for p in present] if values is None else values
    if fold is None:
        fold = fold_of(copy_groups(np.array([sketch(p) for p in present]).reshape(len(present), -1)), folds)
    chosen, weights, earlier = choose_features(present, y, most), [], np.zeros((len(present), 0), np.float32)
    x = _columns(present, values, chosen)
    for j in range(len(names)):
        weights.append(fit_linear(np.concatenate([x, earlier], axis=1), y[:, j]))
        if j < len(names) - 1:
            earlier = np.concatenate([earlier, out_of_fold(present, values, y, j, earlier, fold, most)], axis=1)
    return Chain(names, chosen, weights)


def _worth_sending(rows: DataFrame, y: np.ndarray, fold: np.ndarray, folds: int, most: int) -> set[int]:
    """Features that choose_features takes from all rows (x, y, fold), or from those without one fold; counted in Spark."""
    k = y.shape[1]
    seen = rows.select("fold", "y", F.explode("x").alias("f"))
    sums = [F.sum((F.col("fold") == g).cast("int")).alias(f"n{g}") for g in range(folds)]
    sums += [F.sum(F.when(F.col("fold") == g, F.col("y")[j]).otherwise(0)).alias(f"p{g}_{j}") for g in range(folds) for j in range(k)]
    counts = stage(seen.groupBy("f").agg(F.count("*").alias("n"), *sums).where("n >= 3").drop("n").coalesce(PARTS), "toxic-counts")
    found: set[int] = set()
    for left in (None, *range(folds)):
        used = [g for g in range(folds) if g != left]
        total, scores = int(np.isin(fold, used).sum()), []
        n = sum((F.col(f"n{g}") for g in used), F.lit(0)).cast("double")
        for j in range(k):
            positive = float(y[np.isin(fold, used), j].sum())
            expected = n * positive / max(1, total)
            spread = expected * (1 - positive / max(1, total)) * (1 - n / max(1, total))
            scores.append(F.when(spread > 0, F.pow(sum((F.col(f"p{g}_{j}") for g in used), F.lit(0)) - expected, F.lit(2)) / spread).otherwise(0.0))
        best = counts.select("f", n.alias("n"), F.greatest(*scores, F.lit(0.0)).alias("score")).where("n >= 3 and score > 0")
        found |= {r.f for r in best.orderBy(F.desc("score"), "f").limit(most + 16).collect()}  # a few more, as sums may be rounded otherwise
    return found


def train_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text") -> Chain:
    """The sample's ids and labels number max_rows at most, so they are broadcast."""
    names = list(categories)
    of = labels.where("toxic is not null").select(F.col(key).alias("_k"), *[F.expr(x).cast("int").alias(c) for c, x in categories.items()]).where("_k is not null")
    sample = of.groupBy("_k").agg(*[F.max(c).alias(c) for c in names]).orderBy(F.xxhash64("_k"), "_k").limit(max_rows)
    rows = bounded_batches(docs).select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(sample), "_k")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = WordFeatures()
        for pdf in batches:
            got = [sorted(features(t).items()) for t in pdf["_t"]]
            ids = [np.array([f for f, _ in g], np.int32) for g in got]
            yield pd.DataFrame({"k": pdf["_k"], "y": list(pdf[names].to_numpy(dtype=np.int32)), "s": [sketch(x).tobytes() for x in ids], "x": ids, "v": [np.array([v for _, v in g], np.float32) for g in got]})

    kind = docs.schema[key].dataType.simpleString()
    rows = rows.mapInPandas(tidy(read), f"k {kind}, y array<int>, s binary, x array<int>, v array<float>")
    order = ("k", F.xxhash64("x", "v"))
    rows = stage(rows.orderBy(*order).limit(max_rows).repartition(PARTS), "toxic-rows")  # an id may repeat
    told = rows.select("k", "y", "s", F.xxhash64("x", "v").alias("h")).toPandas().sort_values(["k", "h"])  # folds don't depend on files
    y = np.array(told["y"].tolist(), dtype=np.float32).reshape(len(told), len(names))
    sketches = np.array([np.frombuffer(x, np.uint64) for x in told["s"]]).reshape(len(told), BANDS * WIDTH)
    fold = fold_of(copy_groups(sketches), FOLDS)
    folds = rows.sparkSession.createDataFrame(pd.DataFrame({"k": told["k"], "h": told["h"], "fold": fold}).drop_duplicates(["k", "h"]), f"k {kind}, h long, fold int")
    rows = rows.withColumn("h", F.xxhash64("x", "v")).join(F.broadcast(folds), ["k", "h"])
    wanted = np.array(sorted(_worth_sending(rows, y, fold, FOLDS, FEATURES)), np.int32)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            use = [np.isin(x, wanted) for x in pdf["x"]]
            yield pdf[["k", "h", "y", "fold"]].assign(x=[np.asarray(x, np.int32)[u].tobytes() for x, u in zip(pdf["x"], use, strict=True)], v=[np.asarray(v, np.float32)[u].tobytes() for v, u in zip(pdf["v"], use, strict=True)])

    got = rows.select("k", "h", "y", "fold", "x", "v").mapInPandas(tidy(narrow), f"k {kind}, h long, y array<int>, fold int, x binary, v binary").toPandas().sort_values(["k", "h"])
    y = np.array(got["y"].tolist(), dtype=np.float32).reshape(len(got), len(names))
    return fit_chain([np.frombuffer(x, np.int32) for x in got["x"]], y, names, values=[np.frombuffer(x, np.float32) for x in got["v"]], fold=got["fold"].to_numpy())


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with p_<category> for each, score (the last category's probability) and toxic (1 if score >= threshold); columns of these names are replaced."""
    names = [f"p_{c}" for c in chain.names]

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = WordFeatures(chain.chosen)
        for s in batches:
            yield pd.DataFrame(_share(chain.log_odds([features(t) for t in s])), columns=names)

    kept = [c for c in docs.columns if c not in (*names, "score", "toxic")]
    scored = bounded_batches(docs).withColumn("_p", score(F.col(text)))
    last = F.col(f"_p.{names[-1]}")
    return scored.select(*kept, *[F.col(f"_p.{c}").alias(c) for c in names], last.alias("score"), (last >= threshold).cast("int").alias("toxic"))

"""Quality classifier (operator 10): histogram gradient-boosted trees over statistics of a document's whole text.

Trained on at most max_rows labelled documents, those with the smallest hash of their id; held-out ids never take part.
Scores use the text only. Null and empty texts have all statistics 0 and get a score like any other. A label that is
null is left out, of several labels of an id the smallest counts. Without labels, or with labels of one class, every
score is the smoothed share of that class. Repeated rows are scored each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy, words_of
from .trees import FlatTrees, fit_trees

MAX_ROWS = 20_000
THRESHOLD = 0.3
HELD_OUT_OF = 5

_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), [ord(c) for c in s]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
_STOP, _COMMA, _PIPE, _BANG = (np.arange(256) == ord(c) for c in ".,|!")
_MARK = np.isin(np.arange(256), [ord(c) for c in "#*$&%@^~_=+<>{}[]\\/"])
_BRACKET = np.isin(np.arange(256), [ord(c) for c in "()\"':;-?"])
_MANY = np.arange(256) >= 128
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _STOP, _COMMA, _PIPE, _BANG, _MARK, _BRACKET, _MANY]).astype(np.float64)
STATISTICS = (
    "upper", "lower", "digit", "stop", "comma", "pipe", "bang", "mark", "bracket", "many_byte", "log_chars", "log_words", "mean_word",
    "longest_word", "distinct_words", "commonest_word", "repeats_in_row", "distinct_pairs", "log_lines", "distinct_lines", "lines_end_in_stop", "words_a_line",
)


def statistics(text: str | None) -> list[float]:
    """One value for each of STATISTICS, over the whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    shares = (_CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)).tolist()
    words = words_of(text)
    n, lines = max(1, len(words)), [x for x in text.split("\n") if x]
    counts = Counter(words)
    in_row = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    m = max(1, len(lines))
    return [
        *shares, np.log1p(len(text)), np.log1p(len(words)), len(text) / n, max(map(len, words), default=0), len(counts) / n, max(counts.values(), default=0) / n,
        in_row / n, pairs / max(1, n - 1), np.log1p(len(lines)), len(set(lines)) / m, sum(x.endswith((".", "!", "?")) for x in lines) / m, n / m,
    ]


def held_out(key: Column) -> Column:
    """True for the fifth of ids that training never sees; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> FlatTrees:
    """The sample's ids and labels number max_rows at most, so they are broadcast; the driver gets its statistics only."""
    of = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).where("_k is not null and _y is not null").where(~held_out(F.col("_k")))
    sample = of.groupBy("_k").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(max_rows)
    rows = bounded_batches(docs).select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(sample), "_k").select("_k", "_y", "_t")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["_k"], "y": pdf["_y"].astype(float), "x": [statistics(t) for t in pdf["_t"]]})

    kind = docs.schema[key].dataType.simpleString()
    # an id may repeat in documents: as many rows as the sample has, by id, bound what is sent
    got = rows.mapInPandas(tidy(measured), f"k {kind}, y double, x array<double>").orderBy("k", "x").limit(max_rows).toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(STATISTICS))
    return fit_trees(x, (got["y"].to_numpy() > 0).astype(np.float64))


def score_quality(docs: DataFrame, model: FlatTrees, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column more: the probability that a document's label is 1."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x = np.array([statistics(t) for t in s], dtype=np.float64).reshape(len(s), len(STATISTICS))
            yield pd.Series(model.probability(x), index=s.index)

    return bounded_batches(docs).withColumn(out, F.pandas_udf(tidy(score), "double")(F.col(text)))


def judge_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels, max_rows=max_rows), out="_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the columns of docs."""
    scored = score_quality(docs, train_quality(docs, labels, max_rows=max_rows), out="_quality_score")
    return scored.where(F.col("_quality_score") >= threshold).select(*docs.columns)

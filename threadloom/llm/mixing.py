"""Mixing sources to target weights (operator 2), in DataFrame operations alone.

Shares are set by weight and filled up to a cap of max_copies times a source's size; what is above is shared anew. A
document's expected copies are its source's target by its size (times its importance, if a column has one). Whole
expected copies are certain. For what remains, documents are ranked within their source by Pareto's order: the odds of
a random number, made from the id, divided by the odds of inclusion; they are taken in that order while they fit, and
one more, the best fitting, closes the gap. Thus taken words are as near to the target as that one document allows.

The prefix is found by sums over 1,024 bins of the order and then 1,024 bins of the bin where the target falls, so a
source with a third of all rows is summed before it is shuffled, and only about a millionth of its rows are sorted.
Then each row is judged against its source's threshold; no join of texts takes place.

Null and empty texts have size 0 and are taken 0 words; a null source is a source and comes last; a source of size 0
has target 0. Rows that repeat in id, source and size are taken or left together. Reruns agree. An empty table gives an
empty one; columns of the input stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_COPIES = 2
SEED = "mix-1"
BINS = 1024


def _u(key: Column, seed: str) -> Column:
    """A random number of 52 bits in the open interval (0, 1), the same in each run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """sizes (sk, source, source_size) with target: sources in code point order take the weights in turn.

    A source is full when its cap is at most the level at which all that are not full get level x weight. In order of
    cap by weight the full ones come first, so running sums find the level: beyond the first that is not full they only fall. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_copies
    s = sizes.withColumn("w", w).withColumn("cap", cap)
    ranked = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * float(total_share) - before) / F.sum("w").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", level).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    found = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(found * F.col("w"), F.col("cap")))).drop("w", "cap", "level", "full")


def _boundary(rows: DataFrame, bin_: str, need: str) -> DataFrame:
    """Per source, the bin in which the running size reaches what is needed, and what is needed within it."""
    sums = rows.groupBy("sk", bin_, need).agg(F.sum("size").alias("n"))
    w = Window.partitionBy("sk").orderBy(bin_)
    upto = F.sum("n").over(w)
    found = sums.withColumn("upto", upto).where(F.col("upto") >= F.col(need)).groupBy("sk", need).agg(F.min(F.struct(F.col(bin_), (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
    return found.select("sk", F.col(f"b.{bin_}").alias(f"{bin_}_at"), (F.col(need) - F.col("b.before")).alias(f"{need}_in"))


def mix_sources(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", importance: str | None = None, weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE, max_copies: int = MAX_COPIES, seed: str = SEED, narrow: bool = False,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies; narrow: with key and source alone, from one scan of the texts."""
    sk = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    imp = F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(0.0)), F.lit(0.0)) if importance else F.lit(1.0)
    rows = stage(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), sk.alias("sk"), size.alias("size"), imp.alias("imp"), _u(F.col(key), seed).alias("u")), "mix")

    sizes = rows.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("imp")).alias("imp_size"))
    targets = stage(source_targets(sizes, weights, total_share, max_copies), "mix-targets")

    def placed(df: DataFrame) -> DataFrame:
        expected = F.when(F.col("imp_size") > 0, F.least(F.col("target") / F.col("imp_size") * F.col("imp"), F.lit(float(max_copies)))).otherwise(0.0)
        df = df.withColumn("expected", expected).withColumn("base", F.floor("expected"))
        part = F.col("expected") - F.col("base")
        q = F.when(part > 0, F.col("u") / (1 - F.col("u")) * ((1 - part) / part))
        df = df.withColumn("v", F.coalesce(q / (1 + q), F.lit(1.0)))
        b1 = F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1))
        return df.withColumn("b1", b1).withColumn("b2", F.least(F.floor((F.col("v") * BINS - F.col("b1")) * BINS), F.lit(BINS - 1)))

    at = placed(rows.join(targets.drop("source"), "sk"))
    # whole copies are certain; what they leave of the target is to be filled
    whole = at.groupBy("sk").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("need"))
    whole = stage(whole, "mix-need")
    open_ = at.join(whole, "sk").where((F.col("base") < max_copies) & (F.col("need") > 0) & (F.col("v") < 1))
    first = stage(_boundary(open_, "b1", "need"), "mix-bin")
    inner = open_.drop("need").join(first, "sk").where(F.col("b1") == F.col("b1_at"))
    second = stage(_boundary(inner, "b2", "need_in").join(first.select("sk", "b1_at"), "sk"), "mix-bin")
    edge = open_.drop("need").join(second, "sk").where((F.col("b1") == F.col("b1_at")) & (F.col("b2") == F.col("b2_at")))
    order = F.struct("v", "u", "id", "size")
    # rows alike in all of the order share a running sum, by RANGE
    last = edge.withColumn("upto", F.sum("size").over(Window.partitionBy("sk").orderBy("v", "u", "id", "size"))).where(F.col("upto") <= F.col("need_in_in"))
    last = last.groupBy("sk").agg(F.max(order).alias("last"))
    ends = stage(targets.select("sk", "target", "source_size", "imp_size").join(whole, "sk").join(second.select("sk", "b1_at", "b2_at"), "sk", "left").join(last, "sk", "left"), "mix-ends")

    def in_prefix(df: DataFrame) -> Column:
        """Below the bin of the boundary, or in it up to the last that fits; without a boundary all that may be taken."""
        below = (F.col("b1") < F.col("b1_at")) | ((F.col("b1") == F.col("b1_at")) & (F.col("b2") < F.col("b2_at")))
        inside = (F.col("b1") == F.col("b1_at")) & (F.col("b2") == F.col("b2_at")) & F.col("last").isNotNull() & (order <= F.col("last"))
        return (F.col("base") < max_copies) & (F.col("v") < 1) & (F.col("need") > 0) & F.coalesce(F.col("b1_at").isNull() | below | inside, F.lit(False))

    judged = placed(rows.join(ends, "sk")).withColumn("in", in_prefix(rows))
    left = judged.groupBy("sk").agg((F.first("need") - F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))).alias("gap"))
    left = stage(left, "mix-gap")
    off = F.abs(F.col("size") - F.col("gap"))
    fits = judged.join(left, "sk").where(~F.col("in") & (F.col("base") < max_copies) & (F.col("gap") > 0) & (off < F.col("gap")))
    fill = fits.groupBy("sk").agg(F.min(F.struct(off.alias("off"), F.col("v"), F.col("u"), F.col("id"), F.col("size"))).alias("fill"))
    ends = stage(ends.join(fill, "sk", "left"), "mix-ends")

    if narrow:
        all_rows = placed(rows.join(ends, "sk"))
        names = [F.col("id").alias(key), F.col("source").alias(source)]
    else:
        inputs = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("id"), sk.alias("sk"), size.alias("size"), imp.alias("imp"), _u(F.col(key), seed).alias("u"))
        all_rows = placed(inputs.join(ends, "sk"))
        names = [F.col(f"row.{c}").alias(c) for c in docs.columns]
    filled = F.coalesce(F.struct("v", "u", "id", "size") == F.struct("fill.v", "fill.u", "fill.id", "fill.size"), F.lit(False))
    copies = F.col("base") + F.when(in_prefix(all_rows) | filled, 1).otherwise(0)
    return all_rows.select(*names, F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.cast("long").alias("mix_copies"))


def repeat_copies(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    mixed = mix_sources(docs, **options).where("mix_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*docs.columns)

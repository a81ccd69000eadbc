"""URL filters (operator 3), in DataFrame operations and Spark's FP-growth alone.

A list of host and path rules judges the urls that it covers. These verdicts are the labels from which FP-growth mines
combinations of url tokens; rules of one to three tokens that reach the support and confidence asked for, and that no
shorter rule with the same outcome equals in confidence, judge all other urls. Each rule is held in an inverted index
under its rarest token, so a url meets only the rules of its own tokens. The most confident rule that matches decides,
then the one with more support, then the longer, then the first by its tokens; urls that none matches are allowed.

FP-growth learns from at most max_rows labelled urls, those with the smallest hash; every url is judged. Null urls and
those without "://" have an empty host and path and are judged by the method. Repeated rows are judged each, extra
columns of the input stay, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Fixed values of the query's rule list: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_ROWS = 50_000
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
LONGEST = 3
#: Rules are broadcast up to this number, joined by shuffle beyond it.
BROADCAST_RULES = 20_000
#: The same for sets of tokens with their verdict.
BROADCAST_SETS = 50_000

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _AZ, _az), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct host labels, top-level domain, path parts with runs of digits as one sign, query keys and the fragment's presence."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), r"[/.]"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
            F.when(F.size(labels) > 0, F.array(F.concat(F.lit("top:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
            F.transform(parts, lambda x: F.concat(F.lit("path:"), x)),
            F.transform(keys, lambda x: F.concat(F.lit("query:"), x)),
            F.when(F.coalesce(F.instr(url, "#"), F.lit(0)) > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Ties go to the first in the list."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def mine_rules(labelled: DataFrame, max_rows: int = MAX_ROWS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """labelled (url, tokens, verdict) to rules (anchor, ante, n, verdict, confidence, support)."""
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(max_rows)
    baskets = stage(sample.select(F.concat(F.col("tokens"), F.array(F.concat(F.lit("verdict:"), F.col("verdict")))).alias("items")), "url-baskets")
    empty = baskets.limit(1).count() == 0
    if empty:
        return labelled.sparkSession.createDataFrame([], "anchor string, ante array<string>, n int, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = model.associationRules.where(F.col("consequent")[0].startswith("verdict:") & (F.size("antecedent") <= longest))
    rules = rules.where(~F.exists("antecedent", lambda x: x.startswith("verdict:")))
    rules = rules.select(F.array_sort("antecedent").alias("ante"), F.substring(F.col("consequent")[0], 9, 99).alias("verdict"), F.round("confidence", 12).alias("confidence"), F.round("support", 12).alias("support"))
    rules = stage(rules, "url-rules")
    # a shorter rule that says the same with no less confidence makes a longer one needless
    keyed = rules.select("ante", "verdict", "confidence", F.array_join("ante", "\n").alias("key"))
    a = F.col("ante")
    subsets = F.when(F.size(a) == 2, F.array(a[0], a[1])).when(
        F.size(a) == 3, F.array(*[F.array_join(F.array(*[F.get(a, F.lit(i)) for i in ix]), "\n") for ix in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2))])
    )
    sub = rules.select("ante", "verdict", "confidence", F.explode(subsets).alias("key"))
    covered = sub.join(keyed.select("key", "verdict", F.col("confidence").alias("short")), ["key", "verdict"]).where(F.col("short") >= F.col("confidence")).select("ante", "verdict").distinct()
    rules = rules.join(covered, ["ante", "verdict"], "left_anti")
    spread = rules.select("*", F.explode("ante").alias("token")).join(single, "token")
    anchors = spread.groupBy("ante", "verdict").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    return stage(rules.join(anchors, ["ante", "verdict"]).select("anchor", "ante", F.size("ante").alias("n"), "verdict", "confidence", "support"), "url-rules")


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, **mining: object) -> DataFrame:
    """pages with host, path, rule, verdict and mined (the tokens of the mined rule that decided); columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined")]
    u = F.col("_url")
    base = pages.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), F.col(url).alias("_url"))
    base = base.select("_row", "_url", host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("listed"), tokens_of(u, F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(base.where("rule is not null").select(F.col("_url").alias("url"), "tokens", F.col("listed").alias("verdict")), **mining)
    index = mined.groupBy("anchor").agg(F.collect_list(F.struct("confidence", "support", "n", "ante", "verdict")).alias("found"))
    if mined.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    listed = base.where("rule is not null").select("_row", "host", "path", "rule", F.col("listed").alias("verdict"), F.lit(None).cast("string").alias("mined"))
    rest = base.where("rule is null").drop("rule", "listed")
    # urls with the same tokens get the same verdict, so it is found once for them and comes back by the tokens themselves
    met = rest.select("tokens").distinct().select("tokens", F.explode("tokens").alias("anchor")).join(index, "anchor")
    fits = F.filter("found", lambda r: F.size(F.array_except(r["ante"], F.col("tokens"))) == 0)
    # the greatest by confidence, support and length; the least by tokens among these
    best = F.array_min(F.transform(fits, lambda r: F.struct((-r["confidence"]).alias("c"), (-r["support"]).alias("s"), (-r["n"]).alias("n"), r["ante"].alias("ante"), r["verdict"].alias("verdict"))))
    best = stage(met.select("tokens", best.alias("best")).where("best is not null").groupBy("tokens").agg(F.min("best").alias("best")), "url-verdicts")
    if best.count() <= BROADCAST_SETS:
        best = F.broadcast(best)
    other = rest.join(best, "tokens", "left").select(
        "_row", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.array_join("best.ante", " ").alias("mined")
    )
    return listed.unionByName(other).select(*[F.col(f"_row.{c}").alias(c) for c in kept], "host", "path", "rule", "verdict", "mined")

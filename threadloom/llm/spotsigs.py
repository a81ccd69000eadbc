"""Document fingerprints by spot signatures (operator 7), in DataFrame operations alone.

A signature is a common word (the anchor) and the chain of the two content words that follow it, other common words
being passed over. A text's fingerprint is the sorted set of its signatures' hashes. Words are runs of letters in lower
case. A text without any such signature has all chains of two content words instead, and without these the hash of the
text itself; so every text has a fingerprint, equal texts have equal ones, and null counts as the empty text.

Pairs of near fingerprints are found among distinct fingerprints: sets are dealt out by length so that only lengths
which can reach the threshold meet, each is indexed under its rarest signatures (as many as a partner must share one
of), and candidates are compared by Jaccard. Rows with equal fingerprints are a class, not pairs.

Repeated rows have results each; a repeated or null id takes part like any other (null orders last, rows with the same id
by a hash of their texts). Ids are whole numbers, or text that can be read as such. Extra columns are ignored. An empty
table gives an empty result. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in is it that for as on with was be by he this are at from or an a not have had but they you which "
    "le la les de des du et un une est en que qui pour dans sur pas au par il elle ce se "
    "der die das und ist zu den von mit dem nicht ein eine auf sich des für im auch es "
    "el los las del y una con por para su al lo como más o"
).split()
THRESHOLD = 0.8
#: Rows in a bucket of the order by id, and the most buckets; beyond BUCKET x BUCKETS rows buckets grow, and their sorts spill.
BUCKET, BUCKETS = 1024, 20_000

_UNITS = r"\G((?:(?:" + "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w))) + r") )*+)([^ ]+) "


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the sorted, distinct hashes of a text's signatures, as array<int>."""
    plain = F.concat(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))
    df = df.withColumn("_plain", plain)
    df = df.withColumn("_after", F.regexp_extract_all("_plain", F.lit(_UNITS), F.lit(2)))
    df = df.withColumn("_anchors", F.regexp_extract_all("_plain", F.lit(_UNITS), F.lit(1)))
    units = F.arrays_zip(F.col("_anchors").alias("a"), F.col("_after").alias("c"), F.slice("_after", F.lit(2), F.greatest(F.size("_after"), F.lit(1))).alias("d"))
    df = df.withColumn("_units", F.filter(units, lambda x: x["d"].isNotNull()))
    spots = F.flatten(F.transform(F.filter("_units", lambda x: x["a"] != ""), lambda x: F.transform(F.split(F.rtrim(x["a"]), " "), lambda a: F.hash(a, x["c"], x["d"]))))
    chains = F.transform("_units", lambda x: F.hash(x["c"], x["d"]))
    df = df.withColumn("_spots", spots)
    found = F.when(F.size("_spots") > 0, F.col("_spots")).when(F.size("_units") > 0, chains).otherwise(F.array(F.hash(F.coalesce(F.col(text), F.lit("")))))
    return df.withColumn(out, F.array_sort(F.array_distinct(found))).drop("_plain", "_after", "_anchors", "_units", "_spots")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def as_text(signatures: Column) -> Column:
    """Signatures as eight hexadecimal digits each."""
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), " ")


def _buckets(keys: DataFrame) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The least and the greatest (_key, _hash) of each bucket: ranges of about BUCKET rows, whatever the ids are. BUCKETS at most come to the driver."""
    n = max(1, min(BUCKETS, -(-keys.count() // BUCKET)))
    ranged = keys.repartitionByRange(n, "_key", "_hash").withColumn("_part", F.spark_partition_id())
    ends = ranged.groupBy("_part").agg(F.min(F.struct("_key", "_hash")).alias("low"), F.max(F.struct("_key", "_hash")).alias("high")).collect()
    ends.sort(key=lambda r: tuple(r.low))
    return [tuple(r.low) for r in ends], [tuple(r.high) for r in ends]


def _constant(values: list[int]) -> Column:
    """array<long>, folded to one literal by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _key, _hash, _bucket, _guard: rows dealt out by ranges of ids, each range with the first row of the next.

    Ids and hashes of texts alone are gathered to find the ranges; their first rows are copied as guards, and texts move once.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key")).withColumn("_hash", F.xxhash64("text"))
    low, high = _buckets(rows.select("_key", "_hash"))
    if not low:
        return rows.withColumn("_bucket", F.lit(0)).withColumn("_guard", F.lit(0))
    keys, hashes, top_keys, top_hashes = (_constant([x[i] for x in ends]) for ends in (low, high) for i in (0, 1))

    def not_above(i: Column) -> Column:
        """Whether a bucket's least row is not above this one."""
        k, h = F.get(keys, i), F.get(hashes, i)
        return (k < F.col("_key")) | ((k == F.col("_key")) & (h <= F.col("_hash")))

    # the last bucket that does not start above the row, by halving
    steps = F.lit([2**i for i in reversed(range(len(low).bit_length()))])
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < len(low)) & not_above(at + step), at + step).otherwise(at))
    rows = rows.withColumn("_bucket", bucket)
    top = (F.get(top_keys, F.col("_bucket")) == F.col("_key")) & (F.get(top_hashes, F.col("_bucket")) == F.col("_hash"))
    places = F.when(top, F.array("_bucket", (F.col("_bucket") + 1) % len(low))).otherwise(F.array("_bucket"))
    return rows.withColumn("_places", places).select("doc_id", "text", "_key", "_hash", F.posexplode("_places").alias("_guard", "_bucket"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, by descending id."""
    rows = with_signatures(followed(docs).repartition("_bucket"), "text", "_own")
    order = Window.partitionBy("_bucket").orderBy("_guard", F.desc("_key"), F.desc("_hash"))
    rows = rows.withColumn("_text2", F.lead("text").over(order)).withColumn("_own2", F.lead("_own").over(order)).where("_guard = 0")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.col("_text2"), F.lit(1), third))
    rows = with_signatures(rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "_own", "_own2", edited.alias("_edited")), "_edited", "_new")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("_own")).alias("fingerprint"), as_text(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_own2")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class) for all rows, and (class_a, class_b, likeness) for classes whose Jaccard reaches the threshold."""
    rows = stage(with_signatures(docs.select("doc_id", "text"), "text", "sigs").select("doc_id", "sigs", F.sha2(F.array_join(F.col("sigs").cast("array<string>"), " ").cast("binary"), 256).alias("class")), "spot-sigs")
    sets = stage(rows.groupBy("class").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")), "spot-sets")
    seen = sets.select("class", "n", F.explode("sigs").alias("sig"))
    often = seen.groupBy("sig").agg(F.count("*").alias("often"))
    # rarest first; a partner shares one of the first n - ceil(threshold x n) + 1
    ranked = seen.join(often.where("often > 1"), "sig").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("s"))
    alone = F.col("n") - F.size("s")  # signatures that no other set has come first of all
    prefix = F.greatest(F.col("n") - F.ceil(F.col("n") * threshold) + 1 - alone, F.lit(0)).cast("int")
    index = ranked.select("class", "n", F.explode(F.slice("s", F.lit(1), prefix)).alias("x")).select("class", "n", F.col("x.sig").alias("sig"))
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold))).cast("int")
    a = index.select(F.col("class").alias("class_a"), F.col("n").alias("na"), "sig", F.explode(F.array(band, band + 1)).alias("band"))
    b = index.select(F.col("class").alias("class_b"), F.col("n").alias("nb"), "sig", band.alias("band"))
    met = a.join(b, ["sig", "band"]).where((F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na")))
    met = met.where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("class_a") < F.col("class_b")))).select("class_a", "class_b").distinct()
    left, right = (sets.select(F.col("class").alias(f"class_{x}"), F.col("sigs").alias(f"s{x}")) for x in "ab")
    pairs = met.join(left, "class_a").join(right, "class_b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold)
    return rows.select("doc_id", "class"), pairs.select("class_a", "class_b", "likeness")

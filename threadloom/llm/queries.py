"""The registered query of each operator: it applies the operator to its whole table and derives the result's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import token_digests
from .chosen_path import jaccard_classes
from .common import table
from .html_main import extract_main
from .mixing import mix_sources
from .quality import judge_quality
from .spotsigs import fingerprints
from .substring import dedup_substrings
from .topk import top_k
from .toxicity import score_toxicity, train_toxicity
from .url_rules import judge_urls

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), chain).select("doc_id", "toxic", "score", "p_toxic_junk", "p_toxic_prose", "p_toxic")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), narrow=True)
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.col("mix_copies").alias("copies")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "mined")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return done.select("doc_id", F.col("dedup_words").alias("n_words"), F.col("dedup_removed").alias("n_removed"), F.col("dedup_text").alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_mixing, op3_url_filter, op4_topk, op5_bpe, op6_html_main, op7_spotsigs, op8_jaccard_join, op9_substring_dedup, op10_quality)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
with d as (
  select doc_id, source, coalesce(len({_WORDS}), 0)::bigint as size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w,
    source_size::double * 2 as cap from s),
l as (
  select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
    sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as weights,
    (sum(source_size) over ())::double * 1.5 as total from w),
f as (select *, (total - filled) / weights as level, cap / w <= (total - filled) / weights as is_full from l),
t as (select source, source_size, case when is_full then cap else least(max(case when not is_full then level end) over () * w, cap) end as target from f),
e as (
  select d.*, t.source_size, t.target, case when t.source_size > 0 then least(t.target / t.source_size::double, 2.0::double) else 0 end as expected
  from d join t on d.source is not distinct from t.source),
b as (select *, floor(expected)::bigint as base, expected - floor(expected) as part from e),
q as (select *, case when part > 0 then u / (1 - u) * ((1 - part) / part) end as odds from b),
v as (select *, coalesce(odds / (1 + odds), 1.0::double) as v, target - (sum(base * size) over (partition by source))::double as need from q),
p as (
  select *, base < 2 and need > 0 and v < 1 as open,
    (sum(case when base < 2 and need > 0 and v < 1 then size else 0 end) over (partition by source order by v, u, doc_id, size))::double as upto from v),
i as (select *, open and upto <= need as inside from p),
g as (select *, need - (sum(case when inside then size else 0 end) over (partition by source))::double as gap from i),
c as (select *, not inside and base < 2 and gap > 0 and abs(size - gap) < gap as fits from g),
r as (select *, fits and rank() over (partition by source, fits order by abs(size - gap), v, u, doc_id, size) = 1 as fill from c)
select doc_id, size, source_size, target, ((base + (inside or fill)::int) * size)::bigint as taken, (base + (inside or fill)::int)::bigint as copies from r
"""

_OP4 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 20
"""

_OP8 = rf"""
with recursive d as (select doc_id, {_WORDS} as w from documents where text is not null),
g as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n, md5(string_agg(s, '|' order by s)) as whole from g group by doc_id),
k as (select n.*, min(doc_id) over (partition by whole) as copy_id, count(*) over (partition by whole) as n_copies from n),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as m from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from both_ join k x on x.doc_id = a join k y on y.doc_id = b where m >= 0.8 * (x.n + y.n - m) - 0.000001),
reach as (select a as id, a as root from links union select l.b, r.root from reach r join links l on l.a = r.id)
select documents.doc_id, coalesce(least((select min(root) from reach where id = documents.doc_id), documents.doc_id), documents.doc_id) as class_id,
  coalesce(copy_id, documents.doc_id) as copy_id, coalesce(n_copies, 1) as n_copies, (select count(*) from links where a = documents.doc_id) as n_links
from documents left join k using (doc_id)
"""

_OP9 = rf"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
win as (select doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
m as (select k, min(doc_id) as least from win group by k),
hit as (select doc_id, i from win join m using (k) where doc_id > least),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from hit),
kept as (select doc_id, string_agg(x, ' ' order by j) as t, count(*) as n from word anti join gone using (doc_id, j) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Trained models (1, 3, 6, 10, pipeline), the tokenizer (5) and Spark's hash (7) have no SQL; tests/llm holds these against brute force."""
    return {"op2_mixing": _OP2, "op4_topk": _OP4, "op8_jaccard_join": _OP8, "op9_substring_dedup": _OP9}

"""Queries of the numbered operators over whole tables; each returns its operator's full result."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.llm import (
    bpe,
    embeddings,
    exact,
    mixing,
    negatives,
    passages,
    repeats,
    secrets,
    simhash,
    topk,
    toxicity,
    urls,
    windows,
)
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
URL_RULES = (
    urls.site("allow", "com/"),
    urls.site("block", "example.com/en/"),
    urls.site("allow", "www.example.com/en/"),
    urls.site("block", "net/es/"),
    urls.site("block", "net/fr/"),
)
#: Patterns that judge URLs which no listed rule fits.
URL_PATTERNS = (urls.glob("block", "spam-*"), urls.glob("block", "*.spam-*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), (*URL_RULES, *URL_PATTERNS))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.remember(docs), ["doc_id"])
    base = F.filter("spans", lambda s: s["place"] < len(secrets.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    number = [
        F.size(F.filter(kinds, F.lit(r.name).eqNullSafe)).cast("bigint").alias(f"n_{r.name}") for r in secrets.BASE
    ]
    return found.select(
        "doc_id",
        *number,
        F.sha2(secrets.as_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dedup(table(spark, sf_dir, "documents"), hashed=True)


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup(table(spark, sf_dir, "documents"), hashed=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by its id's CRC goes on from some word with the next few words over and over."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * (-(-(n - a) // p)))[:n]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find(table(spark, sf_dir, "documents"), rewrite=periodic_tail)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.groups(table(spark, sf_dir, "documents"), every_hash=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("full").alias("text_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 50 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_bpe": op2_bpe,
    "op3_topk": op3_topk,
    "op4_url_filter": op4_url_filter,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

URL_SQL = """
with cut as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut
), ruled as (
  select *, '.' || host as dotted, case
    when suffix(dotted, '.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when suffix(dotted, '.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when suffix(dotted, '.net') and starts_with(path, '/es/') then 'net/es/'
    when suffix(dotted, '.net') and starts_with(path, '/fr/') then 'net/fr/'
    when suffix(dotted, '.com') and starts_with(path, '/') then 'com/' end as rule,
    case when rule is not null then null when contains(host || path, '.spam-') then '*.spam-*'
         when starts_with(host || path, 'spam-') then 'spam-*' end as pattern
  from parts
)
select page_id, host, path, rule, case when rule in ('www.example.com/en/', 'com/') then 'allow'
  when rule is not null or pattern is not null then 'block' else 'allow' end as verdict, pattern
from ruled
"""


TOPK_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1]::bigint * z[2]::bigint))::bigint as score
  from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 10
"""

EMBEDDING_SQL = """
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a
), least as (select a, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on a = vec_id
"""


def _spans_sql(name: str, place: int, rule: secrets.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""{name} as (
  select doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
      a := coalesce(list_sum(list_transform(gaps[:i], lambda x: len(x))), 0)
        + coalesce(list_sum(list_transform(m[:i - 1], lambda x: len(x))), 0), p := {place}, k := '{rule.name}',
      b := coalesce(list_sum(list_transform(gaps[:i], lambda x: len(x))), 0)
        + coalesce(list_sum(list_transform(m[:i], lambda x: len(x))), 0), n := len(held[i]))), lambda s: s.n >= {rule.least}) as s
  from (select doc_id, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {rule.group}) as held,
               string_split_regex(t, '{p}') as gaps from docs where regexp_matches(t, '{p}'))
)"""


def _secrets_sql() -> str:
    parts = ",\n".join(_spans_sql(r.name, i, r) for i, r in enumerate(secrets.RULES))
    every = " union all ".join(f"select doc_id, unnest(s) as s from {r.name}" for r in secrets.RULES)
    line = "s.k || ':' || cast(s.a as bigint) || ':' || cast(s.b as bigint)"
    order = "',' order by s.a, s.p"
    counts = ", ".join(
        f"count(*) filter (where s.k = '{r.name}') as n_{r.name}" for r in secrets.BASE
    )
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
{parts},
spans as ({every})
select d.doc_id, {counts},
  sha256(coalesce(string_agg({line}, {order}) filter (where s.p < {len(secrets.BASE)}), '')) as base_sha256,
  coalesce(string_agg({line}, {order}) filter (where s is not null), '') as spans
from (select doc_id from documents) d left join spans on d.doc_id = spans.doc_id group by d.doc_id
"""


EXACT_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

NEGATIVES_SQL = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1]::bigint * z[2]::bigint))::bigint as score
  from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, rank::int as rank, vec_id as negative_id, positive_score, score as negative_score
from (
  select p.*, s.vec_id, s.score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from positives p join scored s on p.anchor_id = s.anchor_id
  where not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
)
where rank <= 3
"""

ORACLE: dict[str, str] = {
    "op1_embedding_dedup": EMBEDDING_SQL,
    "op3_topk": TOPK_SQL,
    "op4_url_filter": URL_SQL,
    "op5_secrets": _secrets_sql(),
    "op12_exact_dedup": EXACT_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}

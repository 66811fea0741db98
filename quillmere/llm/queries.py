"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.centroids import CLUSTERS, DIM, ROUNDS, cluster
from quillmere.llm.decontaminate import contained_items
from quillmere.llm.hard_negatives import hard_negatives
from quillmere.llm.language_id import fit, identify
from quillmere.llm.license_scan import scan_licenses
from quillmere.llm.main_text import main_text
from quillmere.llm.partial_matching import partial_matching_scores
from quillmere.llm.piece_codec import piece_digests
from quillmere.llm.repeats import remove_repeats
from quillmere.llm.secret_scan import scan_secrets
from quillmere.llm.simhash import simhash_components
from quillmere.llm.token_counts import token_counts
from quillmere.llm.transport_stream import media_columns


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    models = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), models, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir), keep=["doc_id"])


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_documents(spark, sf_dir), keep=["doc_id"])


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir), keep=["doc_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label=shifted)


_HARD_NEGATIVES_SQL = """
with e as (
  select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.n as a, a.vec_id as anchor_id, a.label = b.label as same, b.n as b, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and len(a.v) = len(b.v) and a.vec_id <> b.vec_id),
p as (select a, anchor_id, b, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by a order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.a, p.b order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on s.a = p.a and not s.same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _centroids_sql() -> str:
    """Each round as two tables: vectors with the nearest centroid, and the centroids after it."""
    steps = []
    for k in range(ROUNDS + 1):
        apart = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        best = "select n, any_value(vec_id) as vec_id, any_value(v) as v, min(struct_pack(d, cluster)) as best from"
        steps.append(f"a{k} as ({best} (select x.n, x.vec_id, x.v, {apart} as d, c.cluster from x, c{k} c) group by n)")
        if k < ROUNDS:
            sums = f"select best.cluster as cluster, unnest(v) as s, unnest(range({DIM})) as pos from a{k}"
            floor = "((sum(s) - ((sum(s) % count(*)) + count(*)) % count(*)) // count(*))::bigint"
            steps.append(f"m{k} as (select cluster, list(s order by pos) as v from (select cluster, pos, {floor} as s from ({sums}) group by cluster, pos) group by cluster)")
            steps.append(f"c{k + 1} as (select c.cluster, coalesce(m.v, c.v) as v from c{k} c left join m{k} m using (cluster))")
    return f"""
with x as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) as v from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
c0 as (
  select (row_number() over (order by sha256('1:' || vec_id) nulls last, v) - 1)::int as cluster, v from x
  qualify cluster < {CLUSTERS}),
{", ".join(steps)},
r as (select vec_id, best.cluster as cluster, best.d as distance from a{ROUNDS})
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(v, ',')) as centroid_sha256
from r join c{ROUNDS} using (cluster)
"""


def op13_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    aside = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = _documents(spark, sf_dir).select("doc_id", aside.alias("held_out"), "text")
    return partial_matching_scores(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_piece_codec, op2_language_id, op3_simhash, op4_license_scan, op5_media_columns, op6_main_text, op7_repeats, op8_decontaminate, op9_token_counts, op10_secret_scan, op11_hard_negatives, op12_centroids, op13_partial_matching)}
ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": _HARD_NEGATIVES_SQL, "op12_centroids": _centroids_sql()}

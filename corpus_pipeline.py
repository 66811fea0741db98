"""Corpus pipeline: five stages from raw documents to encoded training text.

1. language ID: documents that the language models reject go.
2. near-dedup: of documents linked by a five-word shingle similarity of 0.8 or more one stays.
3. benchmark decontamination: documents that hold a benchmark passage go.
4. secret scans: each secret gives way to a mark; n_chars follows.
5. SentencePiece: every text is encoded and decoded; ids are added.

No document is shortened or sampled. Columns that the input has besides those of ``documents`` come out as they went in, whatever their
names; a result of the last stage whose name is taken gets underscores before it. Null and empty texts have no letter, so the first
stage drops them; equal rows are one group of copies; empty tables give empty ones. ``lang``, ``source`` and ``doc_id`` decide nothing
but which labelled documents the language models learn from.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.batches import column, free_name
from quillmere.llm.decontaminate import without_items
from quillmere.llm.language_id import fit, identify
from quillmere.llm.near_copies import one_of_similar
from quillmere.llm.piece_codec import encode_pieces
from quillmere.llm.queries import held_out, tokenizer_path
from quillmere.llm.secret_scan import scan_secrets
from quillmere.llm.tables import staged
from quillmere.session import ship_package

MARK = "[SECRET]"


def stage(f):
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(ship_package(spark), docs, sf_dir)

    return run


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one column, beside its text: what an operator computes can't meet its names."""
    return docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column("text").alias("text"))


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = fit(docs.where(~held_out()))
    return identify(_packed(docs), models, keep=["row"]).where("not rejected").select("row.*")


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_similar(docs)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


@stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = scan_secrets(_packed(docs), keep=["row"], redact=MARK)
    hit = F.col("spans") != ""
    changed = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    own = {c: F.col("row")[c] for c in docs.columns}
    return found.select(*[(F.when(hit, changed[c]).otherwise(own[c]) if c in changed else own[c]).alias(c) for c in docs.columns])


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = encode_pieces(_packed(docs), tokenizer_path("piece_bpe_32k.model"), keep=["row"])
    same = F.col("decoded") == F.coalesce(F.col("row")["text"], F.lit(""))
    made = {"n_tokens": F.size("piece_ids").cast("long"), "piece_ids": F.col("piece_ids"), "round_trip": same}
    return found.select("row.*", *[c.alias(free_name(name, docs.columns)) for name, c in made.items()])


STAGES = [
    ("language ID", known_language),
    ("near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", encoded),
]

#: SQL can't express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES:
        docs = staged(f(spark, docs, sf_dir))
    return docs

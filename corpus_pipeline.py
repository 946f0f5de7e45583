"""The corpus pipeline: documents to token ids, one operator a stage.

Each stage gets the rows that the stage before kept, as Parquet read again, and
all but the last return the columns of ``documents``. A stage's own tables
(labels, benchmark) are read from ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from tablewright.llm.queries import KEEP_SCORE, table
from tablewright.llm.shared import keep
from tablewright.names import quote_ident

#: The columns that stages read; the others wait under neutral names, so that none can clash.
READ = ("doc_id", "text", "n_chars")


def aside(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(quote_ident(c)).alias(c if c in READ else f"other_{i}") for i, c in enumerate(docs.columns)])


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(c if c in READ else f"other_{i}").alias(c) for i, c in enumerate(docs.columns)])


#: Near copies: five-word shingles, a similarity of 0.8 and more.
SHINGLE, PERCENT = 5, 80
#: Dropped rows up to this count are broadcast, else joined by shuffle.
BROADCAST_ROWS = 200_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return restored(quality.score(aside(docs), model).filter(F.col("score") >= KEEP_SCORE), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document that was nothing else goes."""
    left = line_dedup.deduplicate_lines(aside(docs)).filter("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return restored(left, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    rows = keep(aside(docs).withColumn("row", F.monotonically_increasing_id()), "near_duplicates")
    groups = jaccard_join.link_components(rows, doc_id="row", n=SHINGLE, percent=PERCENT)
    others = keep(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("row")), "near_duplicates")
    few = others.count() <= BROADCAST_ROWS
    return restored(rows.join(F.broadcast(others) if few else others, "row", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return restored(decontaminate.decontaminate(aside(docs), table(spark, sf_dir, "benchmark")).filter("not contaminated"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of the ids and of the text they decode to."""
    vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    # a table between, so that one Python worker at a time has the vocabulary in a task
    ids = keep(bpe.encode(docs.select("doc_id", "text"), vocabulary), "encoding")
    return bpe.decode(ids, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: SQL cannot express the trained classifier and the encoder; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline/{name.replace(' ', '_')}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}


def oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

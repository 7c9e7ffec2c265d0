"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame; all but the last return the columns of documents.

1. quality      documents that the co-trained classifier rejects go
2. line_dedup   line chunks that repeat across documents go from all but the first; a document that loses all its text goes
3. near_dups    of each group of documents linked by 5-word shingles at 0.75 the one with the smallest id stays
4. decontaminate documents that hold a window of ten consecutive words of a benchmark item go
5. pack         the rest is tokenised and packed into sequences of at most 2048 tokens

Where a stage returns text, n_chars is the length of that text.

Defined results: rows that are equal in id and text are one document stored
twice; near_dups keeps one such row. Documents without words
are no good texts (stage 1). A group of documents that all lack
an id keeps one of them. Extra columns pass through, whatever their names. Empty tables give
no rows; very long texts pass each stage whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import write_table
from shoal.llm.queries import tokenizer_path

SEQ_LEN = 2048


def _own() -> str:
    """A prefix for columns of our own that no input has."""
    return "c" + uuid.uuid4().hex[:12]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from shoal.llm.cotrain_quality import score
    labels, own = spark.read.parquet(f"{sf_dir}/labels.parquet"), _own()
    return score(docs, labels, columns=tuple(docs.columns), out=own).filter(f"{own}.keep").drop(own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from shoal.llm.line_chunks import dedup_lines
    own = _own()
    out = dedup_lines(docs, stats=own, windows=True).filter(f"not ({own}.n_removed > 0 and trim(text) = '')")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(f"{own}.n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(own)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from shoal.llm.jaccard_join import groups
    own = _own()
    g, _ = write_table(groups(docs), "groups")
    first = (g.filter("root is not null").groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m")).select("m.doc_id", "m.th"))
    stay = first.unionByName(g.filter("root is null").select("doc_id", "th")).distinct().select(F.col("doc_id").alias(f"{own}id"), F.col("th").alias(f"{own}stay"))
    rows = g.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    kept = docs.withColumn(f"{own}th", F.xxhash64("text")).join(
        stay, F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}th") == F.col(f"{own}stay")), "left_semi")
    if rows.filter("n > 1").limit(1).count():          # of the rows of an id and text the one whose columns hash least
        cols = [F.col(f"`{c}`") for c in docs.columns]
        kept = (kept.groupBy(F.col("doc_id").alias(f"{own}id"), f"{own}th")
                .agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias(f"{own}row")).select(f"{own}row.*"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from shoal.llm.decontaminate import decontaminate as find
    own = _own()
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("key"), "text")
    hits = (find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").filter("n_hit > 0")
            .select(F.col("doc_id.doc_id").alias(f"{own}id"), F.col("doc_id.th").alias(f"{own}hit")).distinct())
    return (docs.withColumn(f"{own}th", F.xxhash64("text"))
            .join(hits, F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}th") == F.col(f"{own}hit")), "left_anti").drop(f"{own}th"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from shoal.llm.packing import best_fit_pack
    return best_fit_pack(docs, tokenizer_path(), SEQ_LEN)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dups", near_dups),
          ("decontaminate", decontaminate), ("pack", pack)]

#: The classifier's fit has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

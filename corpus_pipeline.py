"""A corpus pipeline: languages, exact copies, near copies, mixture, packing. Each stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import exact_dedup, language_id, mixing, ngram_join, packing
from tarnflow.llm.queries import WEIGHTS
from tarnflow.llm.shared import save, text_batches, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language, or in which none has half of the words; a missing label is filled in."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.predict(docs, model, keep=list(COLUMNS)).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= 0.5))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the largest doc_id stays, and of rows that repeat id and text one. The newer half of the ids meets the snapshot of the older one."""
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    old = F.coalesce(F.col("doc_id") <= half, F.lit(True))
    who = F.xxhash64("doc_id", F.lit(1)).alias("who")
    judged = exact_dedup.exact_dedup(docs.where(~old), docs.where(old)).select(who, "text_key", "kept")
    judged = save(judged.groupBy("who", "text_key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "judged")
    rows = docs.select(*COLUMNS).withColumns({"who": who, "text_key": F.xxhash64("text")})
    out = without(rows, ["who", "text_key"], judged.where("not kept")).select(*COLUMNS)
    return out if judged.where("kept and n > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies, directly or through others, the one of the smallest doc_id stays. Rows that share a doc_id stay or go together, those of a null id stay."""
    gone = ngram_join.near_duplicates(docs).where("doc_id > component_id").select("doc_id").distinct()
    return without(docs.select(*COLUMNS), ["doc_id"], save(gone, "gone"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents that hold nine tenths of the tokens, at rates that move sources, languages and topics, fitted on all documents, towards their target weights. Documents without tokens aren't drawn; rows that share a doc_id share their draw."""
    rows = save(mixing.profiled(docs, mixing.fit_topics(docs), keep=list(COLUMNS)), "profiles")
    return mixing.mix(rows, ["source", "lang", "mix_topic"], F.col("mix_tokens"), keep=0.9, given=WEIGHTS).where("mix_keep").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokens=2048)


def _small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose texts go to workers in small batches, so that JVM and workers hold few of them at once."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        text_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("ngram_jaccard_join", drop_near_copies), ("mixing", mix_sources), ("best_fit_packing", pack_sequences)]
STAGES = [(name, _small_batches(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; what the last one returns. Nulls in any column, repeated rows and an empty table pass through as each stage says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language proportions, sampled cells and token ids are beyond SQL.
ORACLE_SQL = None

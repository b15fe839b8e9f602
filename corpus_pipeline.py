"""A corpus pipeline over ``documents``: toxicity, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each as Parquet below
the shared folder and reads it again as the next one's documents, which cuts the lineage. Each stage
judges all rows of its predecessor; all but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metriloom.llm import packing, simhash, suffix, toxicity
from metriloom.session import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are scored as toxic, by examples that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()).select("doc_id", "toxic")
    index = toxicity.fit(docs, labels)
    scored = docs.select(F.col("text").alias("text"), F.struct(*docs.columns).alias("_whole"))
    return toxicity.score(scored, index).where("predicted = 0").select("_whole.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each component of SimHash links: three-word shingles, at most three bits apart."""
    return simhash.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of 400 bytes and more out of the texts, and drops texts that were nothing else."""
    clashing = {c: f"_own_{c}" for c in docs.columns if c in suffix.HELPERS}
    left = suffix.remove_repeats(docs.withColumnsRenamed(clashing), whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    kept = left.where("n_removed = 0 or n_removed < n_bytes").withColumns(changed).drop(*suffix.HELPERS)
    return kept.withColumnsRenamed({new: old for old, new in clashing.items()}).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("suffix", suffix_stage), ("packing", packing_stage)]

#: SQL cannot state these stages; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""A training corpus from documents: drop toxic text, near-duplicates and benchmark passages, mix, write token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import delete, new_path
from stratalens.llm.decontaminate import decontaminated
from stratalens.llm.minhash import without_near_duplicates
from stratalens.llm.mixing import mixed
from stratalens.llm.token_store import read_store, write_store
from stratalens.llm.toxicity import toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Per cent of their shingles that near-duplicates share at least.
SIMILAR = 80
#: Seed of the mixing and of the order of the corpus.
SEED = "mix"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject; each row is judged by its own text, whatever its id."""
    scores = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return scores.where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, a similarity of 0.8 or more."""
    return without_near_duplicates(docs, percent=SIMILAR).select(COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; n_chars follows the text. Documents that are mostly benchmark go."""
    clean = decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights, in globally shuffled order."""
    return mixed(docs, seed=SEED).select(COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus as a verified store of token ids in the mixing's global order: a row for each document and copy."""
    path = new_path(spark, "corpus")
    write_store(docs, path, seed=SEED)
    return read_store(spark, path)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("token_store", write_tokens)]

#: Scores of fitted models, MinHash groups and token ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage-{name}")
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path

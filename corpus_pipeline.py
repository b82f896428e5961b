"""A training-data pipeline over ``documents``: toxic documents go, one of
each group of near duplicates stays, documents with benchmark items go, the
sources are mixed to their targets, the mix is sharded along a Hilbert curve.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from tessera.llm.common import scratch_path
from tessera.llm.queries import toxic_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold.  Null and empty texts stay."""
    return toxicity.clean_documents(spark, docs, toxic_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts linked at
    five-word shingles and a similarity of 0.8; of rows that share its id one
    stays.  Texts without words and null ids are in no group and all stay."""
    kept = near_dedup.near_duplicates(spark, docs.select("doc_id", "text"))
    stay = kept.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    once = docs.join(stay.where("copies = 1").select("doc_id"), "doc_id", "left_semi")
    several = docs.join(stay.where("copies > 1").select("doc_id"), "doc_id", "left_semi")
    empty = F.regexp_count("text", F.lit(mixing.WORD)) == 0
    blank = F.coalesce(empty, F.lit(True))
    first = several.where(~blank).dropDuplicates(["doc_id"])
    return (once.unionByName(first).unionByName(several.where(blank))
            .unionByName(docs.where("doc_id is null")).select(*docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.clean_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken words of every document, a row for each pass over it."""
    return mixing.mixed_documents(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard (0 to 7), slot in it and curve index."""
    return sharding.shard_documents(spark, docs, carry=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages learn a model, hash and walk; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

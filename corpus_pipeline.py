"""The corpus pipeline: five stages over ``documents``, each calling one operator.

    toxicity -> SimHash near-duplicates -> benchmark decontamination -> mixing -> sharding

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps,
which is written as Parquet and read back as the next one's ``docs``. All but the last return the
columns of ``documents``; the last adds size, text_crc32, row_number, shard and slot.

NULL and empty texts are clean, one group of near-duplicates, uncontaminated and without tokens, so the
mix leaves them out unless their cell holds other tokens; a NULL doc_id is kept like any other and loses
to a numbered near-duplicate; repeated rows are near-duplicates, of which one stays; ties go to the
smaller doc_id, then to the smaller hash of the text; texts are processed whole, whatever their length; an
empty table gives an empty result; further columns are carried along whatever their names, but size,
text_crc32, row_number, shard and slot, which the last stage replaces.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from envlab.llm import decontam, mixing, shards, simhash, toxicity
from envlab.llm.common import prepare, store
from envlab.llm.queries import MIX, TOXIC


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored TOXIC or more go."""
    prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: three-word shingles, at most two differing bits."""
    prepare(spark)
    return simhash.keep_first(docs, words=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prepare(spark)
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target mix: rarer ones than wanted come in several copies."""
    prepare(spark)
    return mixing.sample(docs, MIX, budget=mixing.BUDGET)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their shard and slot."""
    prepare(spark)
    return shards.shard_rows(docs, shards=16)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# the toxicity stage's trained model has no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontaminate, mixing, sharding, simhash, toxicity
from emberline.scratch import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject.

    Null and empty texts are kept unless the biases alone reject them; rows with one id are
    scored one by one.  Without labels nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    return toxicity.score(docs, chain).where(~toxicity.rejected(chain)).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word similarity of 0.8, or 4 bits apart by five-word or by four-word shingles.

    The smallest id stays, null being the largest; of texts without words one stays.
    """
    return simhash.keep_one(docs, bits=4, shingles=(5, 4), similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain a benchmark item; null and empty texts contain none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scanned = decontaminate.scan(docs, benchmark)
    return scanned.where("leak IS NULL OR leak.coverage < %s" % decontaminate.COVERAGE).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 3 times; a null source is one like others."""
    return mixing.apply_mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, with their shard and slot (columns of that name are replaced)."""
    return sharding.shard_docs(docs, shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: classifier, fingerprints, tiling and random rounding are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of a folder, each written to the shared scratch; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

"""A training corpus from raw documents: five stages, each one operator of ``flowlake.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` chains them over Parquet files in the shared folder of the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import decontaminate, langid, mixing, sharding, similar
from flowlake.llm.common import materialize, release, table

#: Target weights of the mixture. Sources and names that are not listed have weight 1.
WEIGHTS = {"domain": {"web": 5, "reference": 3, "forum": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
N_SHARDS = 40


def domain_of(source: Column) -> Column:
    """Domain of a source, by the number that ends its name; a source without one is of the web."""
    number = F.regexp_extract(source, "[0-9]+$", 0).try_cast("int") % 3
    return F.when(number == 1, "reference").when(number == 2, "forum").otherwise("web")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and mixed texts without a language that labels half of their letters."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8) stays, that of the smallest doc_id."""
    return similar.drop_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lies in benchmark windows go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as come in, in the target mixture: documents are left out or drawn again."""
    return mixing.mix_documents(docs, domain_of(F.col("source")), WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and position of every document."""
    return shard_by_map(spark, docs)


def shard_by_map(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Shards by the map that the setting ``spark.flowlake.sharding.map`` names, rebalanced for these documents; without it by a map of the run's own."""
    path = spark.conf.get("spark.flowlake.sharding.map", None)
    return sharding.shard_documents(docs, n_shards=N_SHARDS, map_path=path, move=path is not None)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the language model; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)

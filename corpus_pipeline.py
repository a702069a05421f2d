"""A corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontam, mixing, ngram_join, quality, sharding
from attesta.llm.queries import MIX_POWERS, MIX_SHARE, QUALITY_CUT, SHARDS, crc_of_id, table
from attesta.session import apply_settings, staged

BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key is not among ``ids``; rows without one stay."""
    return docs.join(_few(ids, key), key, "left_anti")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose _key is among ``ids``."""
    return docs.join(_few(ids, "_key"), "_key", "left_semi")


def _few(ids: DataFrame, key: str) -> DataFrame:
    ids = staged(ids.select(key).distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # 8 MB of ids


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    trees = quality.train(docs, table(spark, sf_dir, "labels").filter(crc_of_id() % 5 != 0))
    scored = quality.score_documents(docs, trees, score="_quality_score")
    return scored.filter(F.col("_quality_score") >= QUALITY_CUT).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id (rows without one come last).

    Rows are told apart by id and text, so of several rows of one doc_id only near copies of
    something go, and rows without an id take part. Of equal rows of an id one stays; rows without words
    and without an id are copies of nothing.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("_key", key)
    found = staged(ngram_join.near_duplicates(keyed.select("_key", "text"), id_="_key"))
    grouped = found.filter(F.col("_key") != F.col("component_id")).select("_key", F.col("component_id").alias("_group"))
    roots = grouped.select(F.col("_group").alias("_key"), "_group").distinct()
    members = staged(grouped.distinct().unionByName(roots))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")
    ranked = staged(_only(keyed.select("_key", "doc_id"), members).distinct().join(members, "_key").select("_key", "_group", rank.alias("rank")))
    first = ranked.groupBy("_group").agg(F.min("rank").alias("first"))
    copies = ranked.join(first, "_group").filter(F.col("_key") != F.col("first._key")).select("_key")
    kept = _without(keyed, copies, "_key")
    named = F.max(F.col("n_shingles")) > 0
    counts = found.groupBy("_key").agg(F.count("*").alias("n"), named.alias("words")).filter("n > 1")
    with_id = _only(keyed.select("_key", "doc_id"), counts).filter(F.col("doc_id").isNotNull()).select("_key", F.lit(True).alias("_id")).distinct()
    repeated = staged(counts.join(with_id, "_key", "left").filter(F.col("words") | F.col("_id")).select("_key"))
    if not repeated.isEmpty():
        once = _only(kept, repeated).dropDuplicates(["_key"])
        kept = _without(kept, repeated, "_key").unionByName(once)
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked shares of sources, languages and topics."""
    return mixing.sample(docs, MIX_SHARE, MIX_POWERS, mixing.register("text"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

# boosted trees have no SQL form; tests/llm checks every stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(apply_settings(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs

"""Statements against the citations they refer to, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.ranking import difficulty_pick


def ground(statements: DataFrame, citations: DataFrame) -> DataFrame:
    """Classify statements and resolve their references.

    ``statements``: artifact_id, position, text, refs array<int> (1-based).
    ``citations``: artifact_id, rank (from 1, without gaps), source_id, confidence.

    GROUNDED needs at least one reference, all of them in range, and every cited
    source GROUNDED. References before the first bad one stay resolved.
    """
    refs = statements.select("artifact_id", "position", F.posexplode("refs").alias("_at", "_ref"))
    known = citations.select("artifact_id", F.col("rank").cast("int").alias("_ref"), "source_id", "confidence")
    resolved = refs.join(known, ["artifact_id", "_ref"], "left")
    # one group is one statement's own reference list
    per_statement = resolved.groupBy("artifact_id", "position").agg(
        F.min(F.when(F.col("confidence").isNull(), F.col("_at"))).alias("_bad"),
        F.bool_and(F.coalesce(F.col("confidence") == "GROUNDED", F.lit(False))).alias("_all"),
        F.array_sort(F.collect_list(F.struct("_at", "source_id", "confidence"))).alias("_found"),
    )
    kept = F.filter("_found", lambda c: F.col("_bad").isNull() | (c["_at"] < F.col("_bad")))
    cited = F.transform(kept, lambda c: F.struct(c["source_id"].alias("source_id"), c["confidence"].alias("confidence")))
    joined = statements.join(per_statement, ["artifact_id", "position"], "left")
    grounded = F.coalesce(F.col("_all"), F.lit(False))
    return (
        joined.withColumn("confidence", F.when(grounded, F.lit("GROUNDED")).otherwise(F.lit("UNSUPPORTED_DRAFT")))
        .withColumn("citations", F.when(F.col("_found").isNull(), F.array().cast("array<struct<source_id:bigint,confidence:string>>")).otherwise(cited))
        .drop("_bad", "_all", "_found")
    )


def confidence_state(grounded: DataFrame) -> DataFrame:
    """Per artifact: statements in total, grounded, unsupported."""
    return grounded.groupBy("artifact_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("confidence") == "GROUNDED").alias("grounded"),
        F.count_if(F.col("confidence") != "GROUNDED").alias("unsupported"),
    )


def cited_pairs(grounded: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Distinct (artifact, cited source) pairs."""
    return grounded.select(key, F.explode("citations.source_id").alias("source_id")).distinct()


def cited_sources(grounded: DataFrame) -> DataFrame:
    """Distinct cited source ids per artifact, as a sorted array (bounded by the citations offered)."""
    return cited_pairs(grounded).groupBy("artifact_id").agg(
        F.array_sort(F.collect_list("source_id")).alias("source_ids")
    )


def build_links(grounded: DataFrame, difficulties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link tables of an artifact and of its tasks, one task per requested difficulty."""
    sheet_links = cited_pairs(grounded).withColumnRenamed("artifact_id", "worksheet_id")
    tasks = difficulty_pick(grounded, difficulties)
    task_links = (
        tasks.select("artifact_id", "difficulty", F.explode("citations.source_id").alias("source_id"))
        .distinct()
        .withColumnRenamed("artifact_id", "worksheet_id")
    )
    return sheet_links, task_links


def grounding_rates(grounded: DataFrame) -> DataFrame:
    """One row: share of artifacts with a source, of unsupported statements, of cited ids that resolve.

    Counts are combined per artifact first, so no distinct over all statements is needed.
    """
    per_artifact = grounded.groupBy("artifact_id").agg(
        F.max(F.size("citations")).alias("_cited"),
        F.count("*").alias("_statements"),
        F.count_if(F.col("confidence") != "GROUNDED").alias("_unsupported"),
        F.sum(F.size("refs")).alias("_refs"),
        F.sum(F.size("citations")).alias("_resolved"),
    )

    def share(part, whole):
        return F.coalesce(F.try_divide(F.sum(part).cast("double"), F.sum(whole)), F.lit(0.0))

    return per_artifact.agg(
        F.count("*").alias("artifacts"),
        F.coalesce(F.avg((F.col("_cited") > 0).cast("double")), F.lit(0.0)).alias("coverage"),
        share("_unsupported", "_statements").alias("unsupported_rate"),
        share("_resolved", "_refs").alias("resolved_rate"),
    )

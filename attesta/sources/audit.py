"""Append-only audit events and generation provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_events(events: DataFrame) -> DataFrame:
    """Audit rows; ``detail`` is wrapped as JSON and stays null when absent.

    Only metadata columns are taken, so no text of a request can slip in.
    """
    return events.select(
        "event_type",
        "actor_id",
        "subject",
        F.when(F.col("detail").isNotNull(), F.to_json(F.struct("detail"))).alias("details"),
        "severity",
    )


def provenance(artifacts: DataFrame, counts: DataFrame, cited: DataFrame) -> DataFrame:
    """One row per artifact: prompt hash, cited ids, confidence counts, redaction flag.

    ``artifacts``: artifact_id, artifact_type, prompt, redaction_applied, owner_id.
    """
    state = F.to_json(
        F.struct(
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("grounded", F.lit(0)).alias("grounded"),
            F.coalesce("unsupported", F.lit(0)).alias("unsupportedDraft"),
        )
    )
    return (
        artifacts.join(counts, "artifact_id", "left")
        .join(cited, "artifact_id", "left")
        .select(
            "artifact_type",
            "artifact_id",
            F.sha2("prompt", 256).alias("prompt_hash"),
            "redaction_applied",
            F.coalesce("source_ids", F.array().cast("array<bigint>")).alias("source_refs"),
            state.alias("confidence_state"),
            "owner_id",
        )
    )


def correction_provenance(drafts: DataFrame, statements: DataFrame, scores: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per correction draft: prompt hash, all sources that were offered, counts of criteria and statements.

    ``drafts``: artifact_id, prompt, owner_id; ``statements``: artifact_id, confidence_level;
    ``scores``: artifact_id, one row per criterion; ``citations``: artifact_id, source_id. A correction always
    goes out masked, and counts as built on everything that was offered to it, cited or not.
    """
    said = statements.groupBy("artifact_id").agg(
        F.count("*").alias("_said"), F.count_if(F.col("confidence_level") == "LOW").alias("_low")
    )
    rated = scores.groupBy("artifact_id").agg(F.count("*").alias("_rated"))
    offered = citations.filter(F.col("source_id").isNotNull()).select("artifact_id", "source_id").distinct()
    offered = offered.groupBy("artifact_id").agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))
    joined = drafts
    for side in (said, rated, offered):
        joined = joined.join(side, "artifact_id", "left")
    state = F.to_json(
        F.struct(
            F.coalesce("_rated", F.lit(0)).alias("rubricCriteria"),
            F.coalesce("_said", F.lit(0)).alias("feedbackStatements"),
            F.coalesce("_low", F.lit(0)).alias("lowConfidence"),
        )
    )
    return joined.select(
        F.lit("CORRECTION_DRAFT").alias("artifact_type"),
        "artifact_id",
        F.sha2("prompt", 256).alias("prompt_hash"),
        F.lit(True).alias("redaction_applied"),
        F.coalesce("source_ids", F.array().cast("array<bigint>")).alias("source_refs"),
        state.alias("confidence_state"),
        "owner_id",
    )


def append(events: DataFrame, path: str) -> None:
    """Append audit or provenance rows."""
    events.write.mode("append").parquet(path)

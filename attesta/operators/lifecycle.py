"""The source life cycle applied to a whole command table.

The state only moves forward (registered, approved, ingested) until a revocation
ends it. So a source's history is fixed by four positions in its command order:
the first legal register, approve and ingest, and the first revoke. Each is a
``min`` aggregate, combined map-side, so a source with very many commands costs
no more than others and nothing is collected per source. Positions are stored after each
step, one small row per source, and are the hashed side of the joins: commands are never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import staged


TEXTS = ("license_info", "approval_metadata")


def apply_commands(state: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New state per source and one row per refused command; arguments as for ``judge_commands``."""
    new_state, judged = judge_commands(state, commands)
    errors = judged.filter(F.col("error").isNotNull()).select("source_id", "seq", "command", "error")
    return new_state.drop("trust_level"), errors


def judge_commands(state: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state per source, every command with the status after it and its error, null if it was legal).

    ``state``: source_id, lifecycle_status, license_verified, trust_level.
    ``commands``: source_id, seq (unique order in the source), command in
    register / approve / ingest / revoke, license_verified (only for register;
    null keeps the stored value). Where both tables have license_info or approval_metadata, the first
    legal register sets them too, and the first legal approve the latter; null keeps what is stored.
    """
    texts = [c for c in TEXTS if c in state.columns and c in commands.columns]
    stored = state.select(
        "source_id", "lifecycle_status", F.col("license_verified").alias("_verified"), "trust_level", *texts
    )
    of = {kind: F.when(F.col("command") == kind, F.col("seq")) for kind in ("register", "revoke")}
    first = commands.groupBy("source_id").agg(
        F.min(of["revoke"]).alias("t_revoke"),
        F.min(of["register"]).alias("t_register"),
        F.min_by("license_verified", of["register"]).alias("_meta_first"),
        *[F.min_by(c, of["register"]).alias(f"_register_{c}") for c in texts],
    )
    fresh = F.col("lifecycle_status").isin("DISCOVERED", "UNDER_REVIEW")
    base = staged(
        stored.join(first, "source_id", "left")
        .withColumn("t_revoke", F.coalesce("t_revoke", F.lit(1 << 62)))
        .withColumn("t_register", F.when(fresh & (F.col("t_register") < F.col("t_revoke")), F.col("t_register")))
        .withColumn(
            "_may",
            F.coalesce(F.when(F.col("t_register").isNotNull(), F.col("_meta_first")), F.col("_verified"), F.lit(False))
            & ~F.col("trust_level").eqNullSafe(F.lit("UNVERIFIED")),
        )
        .withColumn(
            "_open_from",
            F.when(F.col("lifecycle_status") == "REGISTERED", F.lit(-1).cast("bigint")).otherwise(F.col("t_register")),
        )
    )
    approved_text = [c for c in texts if c == "approval_metadata"]
    step = commands.select("source_id", "seq", "command", *approved_text)
    approvals = (
        step.filter(F.col("command") == "approve")
        .join(base.select("source_id", "_open_from", "t_revoke", "_may").hint("shuffle_hash"), "source_id")
        .filter(F.col("_may") & (F.col("seq") > F.col("_open_from")) & (F.col("seq") < F.col("t_revoke")))
        .groupBy("source_id")
        .agg(F.min("seq").alias("t_approve"), *[F.min_by(c, "seq").alias(f"_approve_{c}") for c in approved_text])
    )
    ready = F.when(F.col("lifecycle_status") == "APPROVED", F.lit(-1).cast("bigint")).otherwise(F.col("t_approve"))
    base = staged(base.join(approvals, "source_id", "left").withColumn("_ready_from", ready))
    ingests = (
        step.filter(F.col("command") == "ingest")
        .join(base.select("source_id", "_ready_from", "t_revoke").hint("shuffle_hash"), "source_id")
        .filter((F.col("seq") > F.col("_ready_from")) & (F.col("seq") < F.col("t_revoke")))
        .groupBy("source_id")
        .agg(F.min("seq").alias("t_ingest"))
    )
    times = staged(base.join(ingests, "source_id", "left"))

    def text(c: str):
        registered = F.when(F.col("t_register").isNotNull(), F.col(f"_register_{c}"))
        later = [F.col(f"_approve_{c}")] if c in approved_text else []
        return F.coalesce(*later, registered, F.col(c)).alias(c)

    new_state = times.select(
        "source_id",
        F.when(F.col("t_revoke") < (1 << 62), F.lit("REVOKED"))
        .when(F.col("t_ingest").isNotNull(), F.lit("INGESTED"))
        .when(F.col("t_approve").isNotNull(), F.lit("APPROVED"))
        .when(F.col("t_register").isNotNull(), F.lit("REGISTERED"))
        .otherwise(F.col("lifecycle_status"))
        .alias("lifecycle_status"),
        F.coalesce(F.when(F.col("t_register").isNotNull(), F.col("_meta_first")), F.col("_verified")).alias(
            "license_verified"
        ),
        "trust_level",
        *map(text, texts),
    )

    marks = times.select(
        "source_id", F.lit(True).alias("_known"), "t_revoke", "t_register", "t_approve", "t_ingest", "_may",
        F.col("lifecycle_status").alias("_initial"),
    )
    judged = step.select("source_id", "seq", "command").join(marks.hint("shuffle_hash"), "source_id", "left")
    before = (
        F.when(F.col("seq") > F.col("t_revoke"), F.lit("REVOKED"))
        .when(F.col("seq") > F.col("t_ingest"), F.lit("INGESTED"))
        .when(F.col("seq") > F.col("t_approve"), F.lit("APPROVED"))
        .when(F.col("seq") > F.col("t_register"), F.lit("REGISTERED"))
        .otherwise(F.col("_initial"))
    )
    legal = (
        F.col("_known").isNotNull()
        & (
            (F.col("command") == "revoke")
            | F.col("seq").eqNullSafe(F.col("t_register"))
            | F.col("seq").eqNullSafe(F.col("t_approve"))
            | F.col("seq").eqNullSafe(F.col("t_ingest"))
        )
    )
    error = (
        F.when(F.col("_known").isNull(), F.lit("UNKNOWN_SOURCE"))
        .when(~F.col("command").isin("register", "approve", "ingest", "revoke"), F.lit("UNKNOWN_COMMAND"))
        .when((F.col("command") == "approve") & (before == "REGISTERED"), F.lit("APPROVAL_REFUSED"))
        .otherwise(F.concat(F.lit("WRONG_STATUS:"), before))
    )
    after = (
        F.when(~legal, before)
        .when(F.col("command") == "register", F.lit("REGISTERED"))
        .when(F.col("command") == "approve", F.lit("APPROVED"))
        .when(F.col("command") == "ingest", F.lit("INGESTED"))
        .otherwise(F.lit("REVOKED"))
    )
    rows = judged.select("source_id", "seq", "command", after.alias("lifecycle_status"), F.when(~legal, error).alias("error"))
    return new_state, rows

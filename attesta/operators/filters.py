"""Row rules: live rows, scope, validity, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.governance import confession_ok, gate_reason, request_reason
from attesta.rules import MIN_CHUNK


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull())


def gate(sources: DataFrame) -> DataFrame:
    """Add ``gate_reason``; null means the source may be ingested."""
    return sources.withColumn("gate_reason", gate_reason("trust_level", "lifecycle_status", "license_verified"))


def valid_at(df: DataFrame, as_of) -> DataFrame:
    """Rows valid at ``as_of`` (open ends allowed) that are not revoked."""
    at = F.lit(as_of)
    return df.filter(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= at))
        & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))
        & ~F.col("lifecycle_status").eqNullSafe(F.lit("REVOKED"))
    )


def confession_violations(df: DataFrame, subject_required: bool = False) -> DataFrame:
    """Rows that break the subject/confession rule (an unknown outcome does not)."""
    return df.filter(~confession_ok("subject", "confession_context", subject_required))


def strand_violations(strands: DataFrame) -> DataFrame:
    """One row per strand and broken rule."""
    rules: dict[str, Column] = {
        "confession_subject_valid": confession_ok("subject", "confession_context", subject_required=True),
        "form_track_only_sek_i": (F.col("school_stage") == "SEK_I")
        | (F.col("school_form").isNull() & F.col("education_track").isNull()),
        "track_requires_form": F.col("education_track").isNull() | F.col("school_form").isNotNull(),
        "valid_to_after_valid_from": F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("valid_from")),
    }
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return strands.select("strand_id", F.explode(broken).alias("rule"))


def validate_requests(df: DataFrame, text: str | None = None) -> DataFrame:
    """Add ``blocked_reason``; with ``text`` the rule for submitted work applies."""
    return df.withColumn(
        "blocked_reason",
        request_reason("subject", "confession", F.col(text) if text else None),
    )


def tenant_scope(df: DataFrame, entitlements: DataFrame, key: str) -> DataFrame:
    """Rows whose owner (or school) is in the entitlement table."""
    return df.join(entitlements.select(key).distinct(), key, "left_semi")


def has_role(df: DataFrame, role: str) -> DataFrame:
    """Users with the role; administrators have every role."""
    return df.filter(F.col("role").isin(role, "ADMIN"))


def unique_violations(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once, as (rule, violating_key, n)."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return counted.select(F.lit(rule).alias("rule"), key.alias("violating_key"), "n")


def short_chunk_violations(chunks: DataFrame, id_: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """Chunks below the minimum length."""
    short = chunks.filter(F.length(text) < MIN_CHUNK)
    return short.select(
        F.lit("chunk_text_min_len").alias("rule"),
        F.col(id_).cast("string").alias("violating_key"),
        F.lit(1).cast("bigint").alias("n"),
    )


def constraint_violations(parts: list[DataFrame]) -> DataFrame:
    """All findings of single rules in one table."""
    return reduce(DataFrame.unionByName, parts)

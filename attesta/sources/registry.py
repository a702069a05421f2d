"""Source registry entries and golden questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.governance import registry_confession, registry_subject, registry_trust
from attesta.functions.text import is_blank
from attesta.operators.joins import new_only
from attesta.rules import QUESTION_CONFESSIONS, QUESTION_DOMAINS, QUESTION_STATUSES

SEED_PATH = "$.sourceSeedId"


def map_registry(entries: DataFrame) -> DataFrame:
    """Trust, subject and confession of registry entries.

    Two findings are reproduced as they are: the type ``legal`` is not ``law`` and
    stays UNVERIFIED, and ``RELIGION_KATH`` is no known subject. ``mapping_note``
    names them.
    """
    note = F.when(F.lower("source_type") == "legal", F.lit("type legal is not mapped")).when(
        registry_subject("subject").isNull(), F.lit("subject is not mapped")
    )
    return entries.select(
        "entry_id",
        "title",
        F.col("official_url").alias("uri"),
        "publisher",
        F.col("license_or_terms").alias("license_info"),
        registry_trust("trust_level", "source_type").alias("trust_level"),
        registry_subject("subject").alias("subject"),
        registry_confession("subject").alias("confession_context"),
        note.alias("mapping_note"),
    )


def load_registry(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append for entries that were not imported yet: a second run appends nothing."""
    fresh = new_only(entries, existing, "entry_id", SEED_PATH)
    return map_registry(fresh).select(
        "*",
        F.lit(False).alias("license_verified"),
        F.lit("DISCOVERED").alias("lifecycle_status"),
        F.lit(1).alias("source_version"),
        F.to_json(F.struct(F.col("entry_id").alias("sourceSeedId"))).alias("approval_metadata"),
    )


def question_errors() -> Column:
    """Names of the invalid fields of a golden question, in checking order."""
    checks = [
        ("id", is_blank("id")),
        ("domain", ~F.coalesce(F.col("domain").isin(QUESTION_DOMAINS), F.lit(False))),
        ("confession_context", ~F.coalesce(F.col("confession_context").isin(QUESTION_CONFESSIONS), F.lit(False))),
        ("competence_area", is_blank("competence_area")),
        ("grade_range", is_blank("grade_range")),
        ("query", is_blank("query")),
        (
            "expected_source_ids",
            F.col("expected_source_ids").isNull() | F.exists("expected_source_ids", lambda x: x.isNull()),
        ),
        ("expected_section", is_blank("expected_section")),
        ("rationale", is_blank("rationale")),
        ("status", ~F.coalesce(F.col("status").isin(QUESTION_STATUSES), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks]))


def validate_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid questions, rejects with ``errors`` and the ``first_error``)."""
    judged = questions.withColumn("errors", question_errors())
    valid = judged.filter(F.size("errors") == 0).drop("errors")
    rejects = judged.filter(F.size("errors") > 0).withColumn("first_error", F.col("errors")[0])
    return valid, rejects

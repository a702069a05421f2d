"""Prompt assembly and the privacy gate in front of a model call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.privacy import redact, residual_pattern
from attesta.functions.text import trim_ws
from attesta.operators.joins import grants_for
from attesta.session import staged


@dataclass(frozen=True)
class PromptTexts:
    """Instruction texts of a prompt; the caller sets the wording of the deployment."""

    grounded: str = "Use only the numbered sources below and cite them as [n]."
    without_sources: str = "No verified source is available. Mark every statement about the curriculum as a draft."
    context_title: str = "KONTEXT:"
    sources_title: str = "QUELLEN:"
    task: str = "State short, single statements on the topic."
    output: str = 'Answer with one JSON object: {"statements":[{"text":"...","citationRefs":[1]}]}'


def citation_lines(citations: str = "citations") -> Column:
    """``[n] title | section | Trust: level`` per citation, in order."""
    return F.transform(
        citations,
        lambda c, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), c["title"], F.lit(" | "), c["page_or_section"],
            F.lit(" | Trust: "), c["trust_level"],
        ),
    )


def context_lines() -> Column:
    """Subject, grade, topic, and constraints and instructions where there are any."""
    confession = F.when(F.col("subject") == "evangelische-religion", F.lit("evangelisch")).when(
        F.col("subject") == "katholische-religion", F.lit("katholisch")
    )
    label = F.when(confession.isNotNull(), F.concat("subject", F.lit(" ("), confession, F.lit(")"))).otherwise(
        F.col("subject")
    )
    constraints = F.filter(F.transform("constraints", trim_ws), lambda c: c != "")
    instructions = F.coalesce(trim_ws("instructions"), F.lit(""))
    lines = F.array(
        F.concat(F.lit("Fach: "), label),
        F.concat(F.lit("Jahrgangsstufe / Klassenstufe: "), "grade_band"),
        F.concat(F.lit("Thema: "), "topic"),
        F.when(
            F.size(constraints) > 0,
            F.concat(F.lit("Besondere Rahmenbedingungen (verbindlich berücksichtigen): "), F.array_join(constraints, "; ")),
        ),
        F.when(
            instructions != "",
            F.concat(F.lit("Zusätzliche Anweisungen der Lehrkraft (verbindlich berücksichtigen): "), instructions),
        ),
    )
    return F.array_compact(lines)


def prompt_assemble(requests: DataFrame, texts: PromptTexts = PromptTexts()) -> DataFrame:
    """Add ``prompt`` and ``prompt_hash`` to requests that carry their citations.

    ``requests``: subject, grade_band, topic, constraints array, instructions,
    citations array<struct<title, page_or_section, trust_level>> (at most k each).
    Without citations the no-source variant is used.
    """
    empty = F.array(F.lit(""))

    def block(*parts: str) -> Column:
        return F.array(*[F.lit(p) for p in parts])

    context = F.concat(block(texts.context_title), context_lines())
    with_sources = F.concat(
        block(texts.grounded), empty, context, empty, block(texts.sources_title), citation_lines(), empty,
        block(texts.task), empty, block(texts.output),
    )
    without = F.concat(block(texts.without_sources), empty, context, empty, block(texts.task), empty, block(texts.output))
    has_sources = F.coalesce(F.size("citations"), F.lit(0)) > 0
    prompt = F.array_join(F.when(has_sources, with_sources).otherwise(without), "\n")
    return requests.withColumn("prompt", prompt).withColumn("prompt_hash", F.sha2("prompt", 256))


# fixed value of the audit trail
NO_SCHOOL_NOTE = "context or schoolId missing — fail-closed"


def redact_then_gate(
    requests: DataFrame, grants: DataFrame, as_of: str, cloud_enabled: bool, text: str = "prompt", carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(decisions, audit rows) for every request.

    ``requests``: request_id, prompt, provider_kind (local or cloud), provider,
    school_id, user_id, subject, grade_band. A local call always passes the route
    check; a cloud call needs the switch, a school and an active grant, in that
    order. Then the masked text is checked for residual personal data, which adds
    an audit row of its own when it blocks. Audit rows carry no request text. Every text is
    masked and checked once: the verdicts are stored, and both results start from them.
    Decisions keep the columns in ``carry``.
    """
    # a cloud call without a named provider asks for grants of "cloud"
    asked = requests.withColumn("_named", F.col("provider")).withColumn("provider", F.coalesce("provider", F.lit("cloud")))
    granted = grants_for(asked, grants, F.expr(f"timestamp_ntz '{as_of}'")).withColumn("provider", F.col("_named")).drop("_named")
    masked = redact(granted, text)
    local = F.col("provider_kind") == "local"
    route = (
        F.when(local, F.lit(None).cast("string"))
        .when(F.lit(not cloud_enabled), F.lit("CLOUD_DISABLED"))
        .when(F.col("school_id").isNull() | F.col("grant_id").isNull(), F.lit("NO_ACTIVE_GRANT"))
    )
    judged = masked.withColumn("_route", route).withColumn(
        "_residual", F.col("_route").isNull() & residual_pattern("redacted_text").isNotNull()
    )
    reason = F.coalesce("_route", F.when(F.col("_residual"), F.lit("RESIDUAL_PII")))
    judged = staged(
        judged.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).select(
            "request_id", *carry, "user_id", "school_id", "provider", "provider_kind", "grant_id", "_route", "_residual",
            "reason", "allowed", "redaction_applied", "categories_hit",
            F.when(F.col("allowed"), F.col("redacted_text")).alias("redacted_text"),
        )
    )
    local = F.col("provider_kind") == "local"
    decisions = judged.select(
        "request_id", *carry, "allowed", "reason", "grant_id", "redaction_applied", "categories_hit", "redacted_text"
    )

    provider = F.coalesce("provider", "provider_kind").alias("provider")
    grant = F.when(~local, F.col("grant_id")).alias("grantId")
    called = F.to_json(F.struct(F.col("redaction_applied").alias("redactionApplied"), F.col("categories_hit").alias("categoriesHit"), provider, grant))
    # a missing school is written as null, with the note why no grant could be looked up
    plain = F.to_json(F.struct(F.col("_route").alias("reason"), provider, F.when(F.col("_route") == "NO_ACTIVE_GRANT", F.col("school_id")).alias("schoolId")))
    without = F.to_json(
        F.struct(F.col("_route").alias("reason"), provider, F.col("school_id").alias("schoolId"), F.lit(NO_SCHOOL_NOTE).alias("note")),
        {"ignoreNullFields": "false"},
    )
    refused = F.when((F.col("_route") == "NO_ACTIVE_GRANT") & F.col("school_id").isNull(), without).otherwise(plain)
    residual = F.to_json(F.struct(F.lit("RESIDUAL_PII").alias("reason"), provider))
    first = F.struct(
        F.when(F.col("_route").isNotNull(), F.lit("llm_gate_cloud_blocked"))
        .when(local, F.lit("llm_gate_local_call"))
        .otherwise(F.lit("llm_gate_cloud_call"))
        .alias("event_type"),
        F.when(F.col("_route").isNotNull(), F.lit("critical")).otherwise(F.lit("info")).alias("severity"),
        F.when(F.col("_route").isNotNull(), refused).otherwise(called).alias("detail"),
    )
    second = F.struct(
        F.lit("llm_gate_pii_guard_fail").alias("event_type"), F.lit("critical").alias("severity"), residual.alias("detail")
    )
    events = F.when(F.col("_residual"), F.array(first, second)).otherwise(F.array(first))
    audit = judged.select("request_id", F.col("user_id").alias("actor_id"), F.explode_outer(events).alias("_e")).select(
        "request_id", "actor_id", F.lit("llm_privacy_gate").alias("subject"), "_e.*"
    )
    return decisions, audit

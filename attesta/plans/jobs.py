"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.governance import confession_ok
from attesta.functions.text import json_repair
from attesta.operators import aggregates, evaluate, filters, grounding, joins, retention
from attesta.operators.ranking import phase_quartiles
from attesta.plans.gateway import PromptTexts, prompt_assemble, redact_then_gate
from attesta.plans.ingest import BROADCAST_IDS
from attesta.plans.retrieve import retrieve_batch
from attesta.rules import TOP_K
from attesta.session import staged
from attesta.sources.index import ChunkIndex
from attesta.sources.audit import audit_events, provenance
from attesta.sources.registry import validate_questions


def generate_inputs_batch(
    requests: DataFrame, strands: DataFrame, points: DataFrame, sources: DataFrame, grants: DataFrame, as_of: str,
    cloud_enabled: bool = False, texts: PromptTexts = PromptTexts(), minimum: str = "USER_APPROVED", k: int = TOP_K,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prompts with gate decision, blocked requests, audit rows); stops before the model call.

    ``requests`` adds to the request columns a ``vector`` of its query text.
    """
    judged = joins.resolve_strand(filters.validate_requests(requests), strands)
    reason = F.coalesce("blocked_reason", F.when(F.col("strand_id").isNull(), F.lit("NO_STRAND")))
    judged = judged.withColumn("blocked_reason", reason)
    blocked = judged.filter(F.col("blocked_reason").isNotNull()).select("request_id", "blocked_reason")
    ready = judged.filter(F.col("blocked_reason").isNull())
    queries = ready.select(
        F.col("request_id").alias("query_id"), "vector", F.col("subject").alias("display_subject")
    )
    # at most k rows per request; stored once for prompts, decisions and audit
    cited = staged(
        retrieve_batch(queries, points, sources, k=k, minimum=minimum, texts=False).select(
            "query_id", "rank", "title", "page_or_section", "trust_level"
        )
    )
    per_request = cited.groupBy(F.col("query_id").alias("request_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "page_or_section", "trust_level"))).alias("citations")
    )
    prompts = prompt_assemble(ready.join(per_request.hint("merge"), "request_id", "left"), texts)
    decisions, audit = redact_then_gate(prompts, grants, as_of, cloud_enabled, carry=("strand_id", "prompt_hash"))
    return decisions, blocked, audit


@dataclass
class Absorbed:
    """Tables that follow from the replies of a model."""

    failures: DataFrame
    statements: DataFrame
    counts: DataFrame
    sheet_links: DataFrame
    task_links: DataFrame
    provenance: DataFrame
    audit: DataFrame


REPLY = "struct<statements: array<struct<text: string, citationRefs: array<int>>>>"


def absorb_responses(responses: DataFrame, citations: DataFrame, difficulties: DataFrame) -> Absorbed:
    """Replies to grounded statements, phases, links, provenance and audit rows.

    ``responses``: artifact_id, artifact_type, prompt, redaction_applied, owner_id, reply.
    A reply without usable statements becomes a failure row.
    """
    parsed = responses.withColumn("_r", F.from_json(json_repair("reply"), REPLY))
    usable = F.coalesce(F.size("_r.statements"), F.lit(0)) > 0
    failures = parsed.filter(~usable).select(
        "artifact_id", F.when(F.col("_r").isNull(), F.lit("NO_JSON")).otherwise(F.lit("NO_STATEMENTS")).alias("reason")
    )
    good = parsed.filter(usable)
    rows = good.select("artifact_id", F.posexplode("_r.statements").alias("position", "_s")).select(
        "artifact_id",
        F.col("position").cast("bigint").alias("position"),
        F.col("_s.text").alias("text"),
        F.coalesce("_s.citationRefs", F.array().cast("array<int>")).alias("refs"),
    )
    grounded = staged(grounding.ground(rows, citations))  # five tables follow from it
    counts = grounding.confidence_state(grounded)
    sheet_links, task_links = grounding.build_links(grounded, difficulties)
    trail = provenance(good.drop("_r", "reply"), counts, grounding.cited_sources(grounded))
    events = audit_events(
        trail.select(
            F.concat(F.lit("generation_"), F.lower("artifact_type")).alias("event_type"),
            F.col("owner_id").alias("actor_id"),
            F.lit("generation").alias("subject"),
            F.col("confidence_state").alias("detail"),
            F.lit("info").alias("severity"),
        )
    )
    return Absorbed(failures, phase_quartiles(grounded), counts, sheet_links, task_links, trail, events)


def evaluate_job(
    questions: DataFrame, points: DataFrame, sources: DataFrame, baseline: DataFrame, k: int = 10, minimum: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores with NDCG, summary, drift). ``questions`` also carries vector and display_subject."""
    questions = staged(questions)  # one row per question, used by every step
    queries = questions.filter(F.col("status") == "active").select(
        F.col("question_id").alias("query_id"), "vector", "display_subject"
    )
    # at most k rows per question; stored once because scores, summary and drift all start here
    ranked = staged(
        retrieve_batch(queries, points, sources, k=k, minimum=minimum, texts=False).select(
            F.col("query_id").alias("question_id"), "rank", "source_id"
        )
    )
    scores = evaluate.score_questions(ranked, questions)
    summary = staged(evaluate.summarize(scores, questions))  # one row per domain
    full = scores.join(evaluate.ndcg(ranked, questions), "question_id")
    return full, summary, evaluate.drift(evaluate.unpivot_means(summary), baseline)


def load_questions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid questions in the shape the evaluation takes, and the rejects."""
    valid, rejects = validate_questions(raw)
    return valid.withColumnRenamed("id", "question_id"), rejects


def govern_report(
    sources: DataFrame, chunks: DataFrame, strands: DataFrame, versions: DataFrame
) -> DataFrame:
    """Governance findings as (check, n): index, life cycle, rules, orphans, versions, duplicates.

    Sources and chunks are read once each: chunks are counted per source, source rows and counts
    meet under the source id (the key of ``sources``), and the findings about both are sums over
    that table, taken per content first.
    """
    alive = F.col("deleted_at").isNull()
    flags = {
        "total": alive,
        "licensed": alive & ~aggregates.is_blank_or_dash("license_info"),
        "unverified": alive & (F.col("trust_level") == "UNVERIFIED"),
        "registered": alive & (F.col("lifecycle_status") == "REGISTERED"),
        "approved": alive & (F.col("lifecycle_status") == "APPROVED"),
        "confession": ~confession_ok("subject", "confession_context"),
    }
    names, none = [*flags, "known"], F.lit(0).cast("bigint")
    facts = sources.select(
        "source_id",
        "content_hash",
        *[F.coalesce(flag.cast("bigint"), none).alias(name) for name, flag in flags.items()],
        F.lit(1).cast("bigint").alias("known"),
        none.alias("chunks"),
    )
    counted = chunks.groupBy("source_id").agg(F.count("*").alias("chunks")).select(
        "source_id", F.lit(None).cast("string").alias("content_hash"), *[none.alias(n) for n in names], "chunks"
    )
    per_source = facts.unionByName(counted).groupBy("source_id").agg(
        F.max("content_hash").alias("content_hash"), *[F.sum(n).alias(n) for n in [*names, "chunks"]]
    )
    # an orphan chunk has a null id or one that no source has; only ids count as orphans
    orphan = F.when((F.col("known") == 0) & F.col("source_id").isNotNull(), F.col("chunks"))
    per_content = per_source.groupBy("content_hash").agg(
        *[F.sum(n).alias(n) for n in [*names, "chunks"]],
        F.count_if((F.col("chunks") > 0) & F.col("source_id").isNotNull()).alias("indexed"),
        F.sum(orphan).alias("orphans"),
    )
    repeated = F.when(F.col("content_hash").isNotNull() & (F.col("known") > 1), F.col("known"))
    sums = per_content.agg(
        *[F.coalesce(F.sum(n), none).alias(n) for n in [*names, "chunks", "indexed", "orphans"]],
        F.coalesce(F.sum(repeated), none).alias("repeated"),
    )
    findings = {
        "index-chunks": F.col("chunks"),
        "index-sources": F.col("indexed"),
        "index-coverage": aggregates.percent(F.col("licensed"), F.col("total")),
        "index-review": F.greatest(none, F.col("total") - F.col("indexed")),
        "gov-unverified": F.col("unverified"),
        "gov-registered": F.nullif("registered", none),
        "gov-approved": F.nullif("approved", none),
        "source-confession": F.col("confession"),
        "orphan-chunks": F.col("orphans"),
        "duplicate-content": F.col("repeated"),
    }
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_id"), v.cast("bigint").alias("n")) for k, v in findings.items()])))

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_id"), "n")

    return (
        rows.filter(F.col("n").isNotNull())
        .unionByName(one(filters.strand_violations(strands), "strand-rules"))
        .unionByName(one(joins.version_heads(versions).filter("conflict"), "version-conflicts"))
    )


@dataclass
class Purged:
    """What is left after a purge, what it did, and its audit rows (the audit log itself stays)."""

    sources: DataFrame
    chunks: DataFrame
    mappings: DataFrame
    plan: DataFrame
    audit: DataFrame


def purge(
    sources: DataFrame, chunks: DataFrame, links: DataFrame, holds: DataFrame, mappings: DataFrame, requests: DataFrame,
    as_of: str, actor: str, since: str = "retained_from", index: ChunkIndex | None = None, number: int = 0,
) -> Purged:
    """Everything that is due at ``as_of``: kept longer than its data class allows (counted from ``since``),
    or deleted or revoked longer than the grace period, unless on legal hold; and expired or
    withdrawn pseudonym mappings. Chunks and links go with their source.

    The due ids and their reasons are stored once; texts of sources are not read. Counted ids that are few
    enough go to chunks and links, so only links of due sources are shuffled. With an ``index``
    the chunks are those it serves; the due ones are deleted from it for real, in the run ``number`` of
    the writer "purge", and the ``chunks`` of the result are what it serves then.
    """
    reason = retention.deletion_reason(as_of, since=since)
    reasons = sources.select("source_id", reason.alias("reason")).filter(F.col("reason").isNotNull())
    reasons = reasons.join(holds.select("source_id"), "source_id", "left_anti")
    due = staged(reasons.groupBy("source_id").agg(F.min("reason").alias("reason")))
    expired = staged(retention.pseudonym_expiry(mappings, requests, as_of).select("student_id", "reason"))
    gone = due.select("source_id")
    gone = F.broadcast(gone) if due.count() <= BROADCAST_IDS else gone

    def events(rows: DataFrame, event: str, subject: str, id_: str) -> DataFrame:
        return rows.select(
            F.lit(event).alias("event_type"),
            F.lit(actor).alias("actor_id"),
            F.lit(subject).alias("subject"),
            F.concat_ws(":", "reason", F.col(id_).cast("string")).alias("detail"),
            F.lit("info").alias("severity"),
        )

    audit = audit_events(
        events(due, "purge_source_ref", "source_ref_purge", "source_id").unionByName(
            events(expired, "purge_pseudonym", "pseudonym_purge", "student_id")
        )
    )
    plan = retention.source_cascade(gone, chunks, links)
    left = chunks.join(gone, "source_id", "left_anti")
    if index is not None:
        plan = staged(plan)  # it names chunks that are deleted now
        index.purge("purge", number, gone)
        left = index.served()
    return Purged(
        sources.join(gone, "source_id", "left_anti"),
        left,
        mappings.join(expired.select("student_id"), "student_id", "left_anti"),
        plan,
        audit,
    )

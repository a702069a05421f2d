"""Deletion, revocation and retention. Every operation returns its audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.rules import GRACE_DAYS, PSEUDONYM_MONTHS, RETENTION_MONTHS


def _ts(as_of: str) -> Column:
    return F.expr(f"timestamp_ntz '{as_of}'")


def _audit(rows: DataFrame, event: str, subject: str, id_: str, label: str, severity: str) -> DataFrame:
    return rows.select(
        F.lit(event).alias("event_type"),
        "actor_id",
        F.lit(subject).alias("subject"),
        F.to_json(F.struct(F.col(id_).cast("string").alias(label))).alias("details"),
        F.lit(severity).alias("severity"),
    )


def soft_delete(
    df: DataFrame, deletes: DataFrame, as_of: str, id_: str = "sheet_id", label: str = "worksheetId",
    event: str = "soft_delete_worksheet", subject: str = "worksheet_deletion",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set ``deleted_at`` for the listed ids: (table, audit rows, unknown ids).

    ``deletes``: id and actor_id, one row per command. Every command on a known id leaves an
    audit row, repeated ones too; unknown ids leave none. Joins hash the ids of one side, so no rows are sorted.
    """
    asked = deletes.select(id_).distinct()
    known = df.select(id_).hint("shuffle_hash")
    marked = df.join(asked.withColumn("_hit", F.lit(True)).hint("shuffle_hash"), id_, "left")
    table = marked.withColumn(
        "deleted_at", F.when(F.col("_hit"), _ts(as_of)).otherwise(F.col("deleted_at"))
    ).drop("_hit")
    audit = _audit(deletes.join(known, id_, "left_semi"), event, subject, id_, label, "info")
    return table, audit, asked.join(known, id_, "left_anti")


def revoke_sources(sources: DataFrame, revocations: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revoke the listed sources: (table, audit rows, unknown ids).

    The first revocation sets ``revoked_at``, from which the grace period before the purge
    runs. Every command on a known source leaves an audit row.
    """
    asked = revocations.select("source_id").distinct()
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    table = (
        sources.join(asked.withColumn("_hit", F.lit(True)), "source_id", "left")
        .withColumn("lifecycle_status", F.when(hit, F.lit("REVOKED")).otherwise(F.col("lifecycle_status")))
        .withColumn("revoked_at", F.when(hit, F.coalesce("revoked_at", _ts(as_of))).otherwise(F.col("revoked_at")))
        .drop("_hit")
    )
    known = revocations.join(sources.select("source_id"), "source_id", "left_semi")
    audit = _audit(known, "revoke_source_ref", "source_ref_revocation", "source_id", "sourceRefId", "warning")
    return table, audit, asked.join(sources.select("source_id"), "source_id", "left_anti")


def _months_kept(data_class: str) -> Column:
    months = F.lit(None).cast("int")
    for name, limit in RETENTION_MONTHS.items():
        months = F.when(F.col(data_class) == name, F.lit(limit)).otherwise(months)
    return months


def _grace_over(as_of: str, grace_days: int) -> Column:
    limit = _ts(as_of) - F.make_dt_interval(days=F.lit(grace_days))
    return (F.col("deleted_at") < limit) | (F.col("revoked_at") < limit)


def deletion_reason(
    as_of: str, data_class: str = "data_class", since: str = "retained_from", grace_days: int = GRACE_DAYS
) -> Column:
    """Why a row is to be deleted at ``as_of``: GRACE_OVER, RETENTION, or null."""
    old = F.add_months(F.col(since).cast("date"), _months_kept(data_class)) < _ts(as_of).cast("date")
    return F.when(_grace_over(as_of, grace_days), F.lit("GRACE_OVER")).when(old, F.lit("RETENTION"))


def retention_due(df: DataFrame, as_of: str, data_class: str = "data_class", since: str = "retained_from") -> DataFrame:
    """Rows older than the retention of their data class; classes without a limit never are."""
    due_from = F.add_months(F.col(since).cast("date"), _months_kept(data_class))
    return df.withColumn("due_from", due_from).filter(F.col("due_from") < _ts(as_of).cast("date"))


def hard_delete_due(
    df: DataFrame, holds: DataFrame, as_of: str, id_: str = "source_id", grace_days: int = GRACE_DAYS
) -> DataFrame:
    """Rows soft-deleted or revoked longer than the grace period, unless on legal hold."""
    return df.filter(_grace_over(as_of, grace_days)).join(holds.select(id_), id_, "left_anti")


def pseudonym_expiry(
    mappings: DataFrame, requests: DataFrame, as_of: str, months: int = PSEUDONYM_MONTHS
) -> DataFrame:
    """Mappings to drop, with the reason: an explicit request first, else the time since leaving."""
    asked = requests.select("student_id").distinct().withColumn("_asked", F.lit(True))
    expired = F.add_months(F.col("left_on"), months) < _ts(as_of).cast("date")
    joined = mappings.join(asked, "student_id", "left").withColumn(
        "reason", F.when(F.col("_asked"), F.lit("REQUEST")).when(expired, F.lit("EXPIRED"))
    )
    return joined.filter(F.col("reason").isNotNull()).drop("_asked")


def cascade_plan(
    unit_deletes: DataFrame, units: DataFrame, sheets: DataFrame, tasks: DataFrame, submissions: DataFrame,
    drafts: DataFrame,
) -> DataFrame:
    """What deleting units does: (table, row_id, action, root unit).

    Units take their sheets, sheets their tasks with them. A submission restricts
    the deletion of its task: the whole unit is then blocked, which also leaves
    its drafts untouched. Only keys travel through the joins.
    """
    roots = units.select("unit_id").join(unit_deletes.select("unit_id").distinct(), "unit_id", "left_semi")
    sheet_rows = sheets.select("sheet_id", "unit_id").join(roots, "unit_id", "left_semi")
    task_rows = tasks.select("task_id", "sheet_id").join(sheet_rows, "sheet_id")
    held = submissions.select("submission_id", "task_id").join(task_rows.select("task_id", "unit_id"), "task_id")
    blocked = held.select("unit_id").distinct().withColumn("_blocked", F.lit(True))

    def rows(df: DataFrame, table: str, id_: str, action: str) -> DataFrame:
        return df.select(F.lit(table).alias("table"), F.col(id_).cast("string").alias("row_id"), F.lit(action).alias("_a"), "unit_id")

    everything = (
        rows(roots, "teaching_unit", "unit_id", "delete")
        .unionByName(rows(sheet_rows, "worksheet", "sheet_id", "delete"))
        .unionByName(rows(task_rows, "task", "task_id", "delete"))
        .unionByName(rows(held, "student_submission", "submission_id", "restrict"))
        .unionByName(
            rows(drafts.select("draft_id", "submission_id").join(held, "submission_id"), "correction_draft", "draft_id", "keep")
        )
    )
    return everything.join(blocked, "unit_id", "left").select(
        "table",
        "row_id",
        F.when(F.col("_blocked") & (F.col("_a") == "delete"), F.lit("blocked")).otherwise(F.col("_a")).alias("action"),
        "unit_id",
    )


def source_cascade(source_deletes: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Chunks and links that go with deleted sources: (table, row_id, action, source_id)."""
    gone = source_deletes.select("source_id").distinct()
    of_chunks = chunks.join(gone, "source_id", "left_semi").select(
        F.lit("rag_chunk").alias("table"), F.col("chunk_id").cast("string").alias("row_id"), "source_id"
    )
    of_links = links.join(gone, "source_id", "left_semi").select(
        F.lit("worksheet_source_ref").alias("table"),
        F.concat_ws("|", F.col("sheet_id").cast("string"), F.col("source_id").cast("string")).alias("row_id"),
        "source_id",
    )
    return of_chunks.unionByName(of_links).withColumn("action", F.lit("delete"))


def strand_cascade(strand_deletes: DataFrame, strands: DataFrame, nodes: DataFrame, units: DataFrame, tasks: DataFrame) -> DataFrame:
    """What deleting strands does: nodes go, tasks lose their node, a unit blocks the strand.

    ``tasks`` carries node_id (nullable). Columns: (table, row_id, action, strand_id).
    """
    gone = strands.select("strand_id").join(strand_deletes.select("strand_id").distinct(), "strand_id", "left_semi")
    node_rows = nodes.select("node_id", "strand_id").join(gone, "strand_id", "left_semi")
    unit_rows = units.select("unit_id", "strand_id").join(gone, "strand_id", "left_semi")
    task_rows = tasks.select("task_id", "node_id").filter(F.col("node_id").isNotNull()).join(node_rows, "node_id")
    blocked = unit_rows.select("strand_id").distinct().withColumn("_blocked", F.lit(True))

    def rows(df: DataFrame, table: str, id_: str, action: str) -> DataFrame:
        return df.select(F.lit(table).alias("table"), F.col(id_).cast("string").alias("row_id"), F.lit(action).alias("_a"), "strand_id")

    everything = (
        rows(gone, "curriculum_strand", "strand_id", "delete")
        .unionByName(rows(node_rows, "curriculum_node", "node_id", "delete"))
        .unionByName(rows(task_rows, "task", "task_id", "set-null"))
        .unionByName(rows(unit_rows, "teaching_unit", "unit_id", "restrict"))
    )
    return everything.join(blocked, "strand_id", "left").select(
        "table",
        "row_id",
        F.when(F.col("_blocked") & (F.col("_a") != "restrict"), F.lit("blocked")).otherwise(F.col("_a")).alias("action"),
        "strand_id",
    )

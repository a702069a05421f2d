"""Upserts, deletes and commits of chunk rows as plain table operations (``sources.index`` stores them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.search import filter_condition


def upsert(base: DataFrame, delta: DataFrame, key: str = "point_id", batch: str = "batch") -> DataFrame:
    """Later writes replace earlier ones of the same id.

    ``delta`` may hold several batches; the highest ``batch`` wins. ``base`` rows
    only need a semi-filter against the changed ids, never a sort.
    """
    newest = Window.partitionBy(key).orderBy(F.col(batch).desc())
    last = delta.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n", batch)
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(*[c for c in base.columns]), allowMissingColumns=False)


def tag_source(points: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Force the source id of the ingest into the payload: (point_id, source_id) wins over what points carry."""
    return points.drop("source_id").join(source_ids.select("point_id", "source_id"), "point_id")


def delete_where(
    points: DataFrame, source_id=None, trust_level_not=None, subject=None, confessions: list[str] | None = None
) -> DataFrame:
    """What is left after deleting all points that pass the filter; an empty filter is refused."""
    condition = filter_condition(trust_level_not, subject, confessions, source_id)
    if condition is None:
        raise ValueError("an empty filter would delete the whole collection")
    return points.filter(~condition)


def delete_ids(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    """What is left after deleting exactly the given ids."""
    return points.join(ids.select(key), key, "left_anti")


def commit(written: DataFrame, sources: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks that become visible, sources after the commit, point ids to remove again).

    ``written`` holds the chunks of one run. A source that is no longer APPROVED
    when the commit runs keeps its status, and its staged points are removed.
    """
    written_ids = written.select("source_id").distinct()
    approved = sources.filter(F.col("lifecycle_status") == "APPROVED").select("source_id")
    good = written_ids.join(approved, "source_id", "left_semi")
    visible = written.join(good, "source_id", "left_semi")
    undone = written.select("point_id", "source_id").join(good, "source_id", "left_anti").select("point_id")
    marks = good.join(hashes.select("source_id", F.col("content_hash").alias("_hash")), "source_id", "left").withColumn(
        "_done", F.lit(True)
    )
    updated = (
        sources.join(marks, "source_id", "left")
        .withColumn("lifecycle_status", F.when(F.col("_done"), F.lit("INGESTED")).otherwise(F.col("lifecycle_status")))
        .withColumn("content_hash", F.when(F.col("_done"), F.col("_hash")).otherwise(F.col("content_hash")))
        .drop("_done", "_hash")
    )
    return visible, updated, undone

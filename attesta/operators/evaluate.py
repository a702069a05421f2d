"""Retrieval quality: scores per question, roll-up and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.rules import DRIFT_EPSILON, DRIFT_THRESHOLD


def relevant_hits(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits whose source is expected; repeated sources all stay (a semi join keeps the multiset)."""
    expected = questions.select("question_id", F.explode("expected_source_ids").alias("source_id"))
    return ranked.join(expected, ["question_id", "source_id"], "left_semi")


def score_questions(ranked: DataFrame, questions: DataFrame, k_precision: int = 5, k_recall: int = 10) -> DataFrame:
    """P@5, R@10 and reciprocal rank per active question.

    ``ranked``: question_id, rank (from 1), source_id.
    ``questions``: question_id, domain, status, expected_source_ids.
    Precision divides by k, recall by the raw length of the expected list.
    """
    hits = relevant_hits(ranked, questions)
    found = hits.groupBy("question_id").agg(
        F.count_if(F.col("rank") <= k_precision).alias("_p"),
        F.count_if(F.col("rank") <= k_recall).alias("_r"),
        F.min("rank").alias("_first"),
    )
    n_expected = F.size("expected_source_ids")
    zero = F.lit(0.0)
    return (
        questions.filter(F.col("status") == "active")
        .join(found, "question_id", "left")
        .select(
            "question_id",
            "domain",
            F.coalesce(F.col("_p") / F.lit(float(k_precision)), zero).alias("precision_at_5"),
            F.when(n_expected > 0, F.coalesce(F.col("_r") / n_expected, zero)).otherwise(zero).alias("recall_at_10"),
            F.coalesce(F.lit(1.0) / F.col("_first"), zero).alias("reciprocal_rank"),
        )
    )


def summarize(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per domain and one over all (``domain`` null): count, means, total, skipped.

    Means are over active questions and 0 when there are none; totals only on the overall row.
    """
    metrics = ["precision_at_5", "recall_at_10", "reciprocal_rank"]
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in metrics]
    rolled = (
        scores.groupingSets([[], [F.col("domain")]], "domain")
        .agg(F.grouping("domain").alias("_all"), F.count("*").alias("questions"), *means)
    )
    # the overall row must exist even without any score
    totals = questions.agg(
        F.count("*").alias("total"), F.count_if(~F.col("status").eqNullSafe(F.lit("active"))).alias("skipped")
    )
    both = totals.unionByName(rolled.filter(F.col("_all") == 1).drop("_all", "domain"), allowMissingColumns=True)
    zero = F.lit(0.0)
    head = both.agg(
        F.coalesce(F.max("questions"), F.lit(0)).cast("bigint").alias("questions"),
        *[F.coalesce(F.max(f"mean_{m}"), zero).alias(f"mean_{m}") for m in metrics],
        F.max("total").alias("total"),
        F.max("skipped").alias("skipped"),
    ).select(F.lit(None).cast("string").alias("domain"), "*")
    body = rolled.filter(F.col("_all") == 0).select(
        "domain", "questions", *[f"mean_{m}" for m in metrics],
        F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("skipped"),
    )
    return head.unionByName(body)


def unpivot_means(summary: DataFrame) -> DataFrame:
    """(domain, metric, value) rows of a summary."""
    columns = ["mean_precision_at_5", "mean_recall_at_10", "mean_reciprocal_rank"]
    return summary.unpivot("domain", columns, "metric", "value")


def drift(current: DataFrame, baseline: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Metrics that fell below the baseline by more than the threshold (one-sided).

    Both sides: domain (null = overall), metric, value. A missing baseline never drifts.
    """
    base = baseline.select(F.col("domain").alias("_d"), F.col("metric").alias("_m"), F.col("value").alias("baseline"))
    joined = current.join(base, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("metric") == F.col("_m")), "left")
    fallen = F.col("baseline") - F.col("value") > F.lit(threshold + DRIFT_EPSILON)
    return joined.filter(fallen).select(
        "domain", "metric", "baseline", F.col("value").alias("current"), (F.col("value") - F.col("baseline")).alias("delta")
    )


def _log2(n: Column) -> Column:
    return F.log2(n.cast("double"))


def ndcg(ranked: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Binary NDCG@k per active question; 0 where nothing is expected."""
    gains = (
        relevant_hits(ranked, questions)
        .filter(F.col("rank") <= k)
        .groupBy("question_id")
        .agg(F.sum(F.lit(1.0) / _log2(F.col("rank") + 1)).alias("_dcg"))
    )
    ideal_hits = F.least(F.size("expected_source_ids"), F.lit(k))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.lit(k)),
        F.lit(0.0),
        lambda acc, i: acc + F.when(i <= ideal_hits, F.lit(1.0) / _log2(i + 1)).otherwise(F.lit(0.0)),
    )
    return (
        questions.filter(F.col("status") == "active")
        .join(gains, "question_id", "left")
        .select("question_id", F.coalesce(F.try_divide(F.col("_dcg"), ideal), F.lit(0.0)).alias("ndcg"))
    )

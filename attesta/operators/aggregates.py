"""Roll-ups for dashboards and governance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.governance import display_subject
from attesta.functions.privacy import redacted
from attesta.rules import DISPLAY_SUBJECTS, ERROR_RATE_LIMIT, LATENCY_P95_TARGET_MS, REDACTION, SUBJECT_LABELS
from attesta.session import staged


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 for an empty whole."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(F.lit(0)).cast("bigint")


def index_quality(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Coverage of the index: one row. ``indexed_share`` is indexed over registered sources."""
    indexed = chunks.groupBy("source_id").agg(F.count("*").alias("_n"))
    of_chunks = indexed.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks"), F.count("*").alias("indexed_sources")
    )
    of_sources = sources.agg(
        F.count("*").alias("total"), F.count_if(~is_blank_or_dash("license_info")).alias("_licensed")
    )
    both = of_sources.unionByName(of_chunks, allowMissingColumns=True)
    joined = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return joined.select(
        "chunks",
        "indexed_sources",
        "total",
        percent(F.col("_licensed"), F.col("total")).alias("metadata_coverage"),
        percent(F.col("indexed_sources"), F.col("total")).alias("indexed_share"),
        F.greatest(F.lit(0), F.col("total") - F.col("indexed_sources")).cast("bigint").alias("needing_review"),
        F.when(F.col("chunks") > 0, F.lit("aktuell")).otherwise(F.lit("leer")).alias("freshness"),
    )


def is_blank_or_dash(col: str) -> Column:
    """No licence stated: null, empty, or the dash that stands for a missing value."""
    return F.coalesce(F.col(col), F.lit("")).isin("", "—")


def governance_counts(sources: DataFrame) -> DataFrame:
    """Check id and count: unverified always, registered and approved only when there are any."""
    counts = sources.filter(F.col("deleted_at").isNull()).agg(
        F.count_if(F.col("trust_level") == "UNVERIFIED").alias("unverified"),
        F.count_if(F.col("lifecycle_status") == "REGISTERED").alias("registered"),
        F.count_if(F.col("lifecycle_status") == "APPROVED").alias("approved"),
    )
    rows = counts.selectExpr(
        "stack(3, 'gov-unverified', unverified, 'gov-registered', registered, 'gov-approved', approved)"
        " AS (check_id, n)"
    )
    return rows.filter((F.col("check_id") == "gov-unverified") | (F.col("n") > 0))


def dashboard_metrics(units: DataFrame, sheets: DataFrame, drafts: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Per owner: active units, sheets of the last seven days, open drafts, and the shared source count."""
    alive = F.col("deleted_at").isNull()
    week = F.expr(f"timestamp_ntz '{as_of}' - interval 7 days")
    unit_counts = units.filter(alive & (F.col("status") != "ARCHIVED")).groupBy("owner_id").agg(F.count("*").alias("units"))
    sheet_counts = sheets.filter(alive & (F.col("created_at") >= week)).groupBy("owner_id").agg(F.count("*").alias("sheets"))
    draft_counts = drafts.filter(alive & (F.col("status") == "DRAFT")).groupBy("owner_id").agg(F.count("*").alias("drafts"))
    total = sources.filter(alive).agg(F.count("*").alias("sources"))
    owners = unit_counts.join(sheet_counts, "owner_id", "full").join(draft_counts, "owner_id", "full")
    zero = F.lit(0).cast("bigint")
    return owners.select(
        "owner_id",
        *[F.coalesce(c, zero).alias(c) for c in ("units", "sheets", "drafts")],
        total.scalar().alias("sources"),
    )


def exclusion_summary(files: DataFrame) -> DataFrame:
    """Files per classification reason."""
    return files.groupBy("reason", "include").agg(F.count("*").alias("files"))


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """Sources and chunks per outcome (ingested, skipped or failed, with the reason)."""
    return outcomes.groupBy("outcome", "reason").agg(
        F.count("*").alias("sources"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("chunks")
    )


def redaction_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts hit per redaction category, and its masks in them afterwards."""
    found = df.select(redacted(text).alias("_r"))
    rows = []
    for category, mask, _ in REDACTION:
        left = F.length("_r.text") - F.length(F.replace(F.col("_r.text"), F.lit(mask), F.lit("")))
        hit = F.array_contains("_r.categories", F.lit(category))
        rows.append(F.struct(F.lit(category).alias("category"), hit.alias("hit"), F.floor(left / len(mask)).alias("masks")))
    # one row per text and category hit; combined before the shuffle
    each = found.select(F.explode(F.array(*rows)).alias("_c")).filter("_c.hit")
    return each.groupBy("_c.category").agg(F.count("*").alias("texts"), F.sum("_c.masks").alias("masks"))


def available_subjects(strands: DataFrame) -> DataFrame:
    """Display subjects that have an active strand, in the fixed order."""
    order = {s: i for i, s in enumerate(DISPLAY_SUBJECTS)}
    display = display_subject("subject", "confession_context")
    place = F.lit(None).cast("int")
    label = F.lit(None).cast("string")
    for name, i in order.items():
        place = F.when(F.col("display_subject") == name, F.lit(i)).otherwise(place)
        label = F.when(F.col("display_subject") == name, F.lit(SUBJECT_LABELS[name])).otherwise(label)
    return (
        strands.filter(F.col("status") == "ACTIVE")
        .select(display.alias("display_subject"))
        .distinct()
        .select("display_subject", place.alias("position"), label.alias("label"))
        .orderBy("position")
    )


def feedback_text(statements: DataFrame, draft: str = "draft_id", order: str = "position", text: str = "text") -> DataFrame:
    """All statement texts of a draft, in order, a blank line between them.

    The answer is one text per draft, so its size is the size of one row. Texts
    are first joined in runs of consecutive positions, so the last step only
    strings runs together.
    """
    run = F.floor(F.col(order) / 512)

    def joined(source: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.col(value).alias("t"))))
        return source.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["t"]), "\n\n").alias("_t"))

    runs = joined(statements.withColumn("_run", run), [draft, "_run"], order, text)
    return joined(runs, [draft], "_run", "_t").withColumnRenamed("_t", "feedback_text")


def feedback_counts(drafts: DataFrame) -> DataFrame:
    """Rubric criteria, statements and low-confidence statements per draft (from its arrays)."""
    return drafts.select(
        "draft_id",
        F.coalesce(F.size("rubric_scores"), F.lit(0)).cast("bigint").alias("rubric_criteria"),
        F.coalesce(F.size("statements"), F.lit(0)).cast("bigint").alias("feedback_statements"),
        F.size(F.filter("statements", lambda s: s["level"] == "LOW")).cast("bigint").alias("low_confidence"),
    )


def source_footer(artifacts: DataFrame) -> DataFrame:
    """Numbered source list per artifact with locator, licence, derivation and own licence.

    ``artifacts``: artifact_id, sources array<struct<title, locator, license>>,
    derivation_source, license.
    """

    def part(value: Column, before: str, after: str) -> Column:
        stated = F.coalesce(value, F.lit("")) != ""
        return F.when(stated, F.concat(F.lit(before), value, F.lit(after))).otherwise(F.lit(""))

    lines = F.transform(
        "sources",
        lambda s, i: F.concat(
            (i + 1).cast("string"),
            F.lit(". "),
            s["title"],
            part(s["locator"], ", ", ""),
            part(s["license"], " (", ")"),
        ),
    )
    extra = F.filter(
        F.array(part(F.col("derivation_source"), "Adaptiert von: ", ""), part(F.col("license"), "Lizenz: ", "")),
        lambda line: line != "",
    )
    return artifacts.select(
        "artifact_id", F.array_join(F.concat(F.array(F.lit("Quellen:")), lines, extra), "\n").alias("footer")
    )


def duplicate_hash_report(sources: DataFrame, hash_: str = "content_hash") -> DataFrame:
    """(hash, copies, member) rows for every content held by more than one source.

    Members stay rows, so a content with very many holders never becomes one value.
    """
    held = sources.filter(F.col(hash_).isNotNull())
    repeated = held.groupBy(hash_).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    return held.select(hash_, "source_id").join(repeated, hash_)


def _flags(report: DataFrame, target: float, error_limit: float) -> DataFrame:
    return report.withColumn("latency_alert", F.col("p95") > target).withColumn("error_alert", F.col("error_rate") > error_limit)


def _measured(latency: str) -> Column:
    return F.when(~F.isnan(F.col(latency)), F.col(latency).cast("double"))


def latency_report(
    df: DataFrame,
    keys: list[str],
    latency: str = "latency",
    is_error: Column | None = None,
    target: float = LATENCY_P95_TARGET_MS,
    error_limit: float = ERROR_RATE_LIMIT,
    accuracy: int = 10_000,
) -> DataFrame:
    """Count, exact interpolated p95 latency and error rate per key, with flags over the limits.

    A sketch with a rank error of 1 / ``accuracy`` brackets the percentile of each group of at least
    ``accuracy`` rows; of a smaller one the bracket is all of it. Values under the bracket are only
    counted, those in it are counted by value and added up in order: about 1 in 2,500 rows
    of a large group, so no task ever holds or sorts a whole one. Null and
    NaN latencies are not measured values: they count as events only, and a group without
    any other has a null p95. Null keys are a group of their own.
    """
    error = is_error if is_error is not None else F.col("is_error")
    rows = df.withColumn("_l", _measured(latency))
    margin = 2.0 / accuracy
    probes = F.percentile_approx("_l", [0.95 - margin, 0.95 + margin], accuracy)
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("events"),
        (F.count_if(error) / F.count("*")).alias("error_rate"),
        F.count("_l").alias("_n"),
        probes.alias("_probes"),
        F.min("_l").alias("_min"),
        F.max("_l").alias("_max"),
    )
    large = F.col("_n") >= accuracy
    # position of the percentile among the sorted values, from 0, and the value before which it lies
    groups = staged(
        groups.withColumn("_at", (F.col("_n") - 1) * F.lit(0.95)).withColumn("_below", F.floor("_at")).select(
            *keys, "events", "error_rate", "_at", "_below",
            F.when(large, F.col("_probes")[0]).otherwise(F.col("_min")).alias("_low"),
            F.when(large, F.col("_probes")[1]).otherwise(F.col("_max")).alias("_high"),
        )
    )

    def beside(side: DataFrame, *columns: str) -> tuple[DataFrame, Column]:
        """A side with its keys renamed, and the condition that they equal the plain ones (null with null)."""
        renamed = side.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
        return renamed, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])

    near = rows.select(*keys, "_l").join(*beside(groups.filter(F.col("_low").isNotNull()), "_low", "_high", "_at", "_below"))
    near = near.filter(F.col("_l") <= F.col("_high")).withColumn("_v", F.when(F.col("_l") >= F.col("_low"), F.col("_l")))
    counts = near.groupBy(*keys, "_at", "_below", "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_upto", F.sum("_c").over(order))
    # the first values that reach the positions around the percentile
    first = F.min(F.when(F.col("_upto") > F.col("_below"), F.col("_v")))
    second = F.min(F.when(F.col("_upto") > F.ceil("_at"), F.col("_v")))
    found = summed.groupBy(*keys, "_at", "_below").agg(first.alias("_a"), second.alias("_b"))
    share = F.col("_at") - F.col("_below")
    # two terms, so that equal infinite neighbours do not cancel
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * (1 - share) + F.col("_b") * share)
    p95 = found.select(*keys, value.alias("p95"))
    out = groups.join(*beside(p95, "p95"), "left").select(*keys, "events", "error_rate", "p95")
    return _flags(out, target, error_limit)


SKETCH_K = 800


def latency_sketch_report(
    df: DataFrame,
    keys: list[str],
    is_error: Column,
    latency: str = "latency",
    target: float = LATENCY_P95_TARGET_MS,
    error_limit: float = ERROR_RATE_LIMIT,
    k: int = SKETCH_K,
) -> DataFrame:
    """``latency_report`` from one KLL sketch per group: a state of bounded size (some 10 KB), whatever values occur.

    p95 is the nearest rank: the smallest value that at least 95 % of the values do not exceed. It
    is exact up to ``k`` values a group. Beyond, it lies between the percentiles 94.5 and 95.5 with
    99 % confidence at the default ``k``.
    """
    rows = df.withColumn("_l", _measured(latency))
    report = rows.groupBy(*keys).agg(
        F.count("*").alias("events"),
        (F.count_if(is_error) / F.count("*")).alias("error_rate"),
        F.kll_sketch_agg_double("_l", k).alias("_sketch"),
    )
    some = F.kll_sketch_get_n_double("_sketch") > 0
    p95 = F.when(some, F.kll_sketch_get_quantile_double("_sketch", F.lit(0.95)))
    return _flags(report.withColumn("p95", p95).drop("_sketch"), target, error_limit)


def latency_counts(df: DataFrame, keys: list[str], is_error: Column, latency: str = "latency") -> DataFrame:
    """Rows and errors per key and measured value: what ``latency_rank_report`` starts from."""
    rows = df.withColumn("_l", _measured(latency))
    return rows.groupBy(*keys, "_l").agg(F.count("*").alias("_c"), F.count_if(is_error).alias("_e"))


def latency_rank_report(
    counts: DataFrame, keys: list[str], target: float = LATENCY_P95_TARGET_MS, error_limit: float = ERROR_RATE_LIMIT
) -> DataFrame:
    """``latency_report`` from ``latency_counts``, with the exact nearest rank as p95: the smallest value that
    at least 95 % of the values do not exceed. A group is sorted by its different values."""
    measured = F.when(F.col("_l").isNotNull(), F.col("_c")).otherwise(F.lit(0))
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.col("_l").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum(measured).over(order)).withColumn("_n", F.sum(measured).over(group))
    reached = F.col("_upto") * 100 >= F.col("_n") * 95
    report = placed.groupBy(*keys).agg(
        F.sum("_c").alias("events"),
        (F.sum("_e") / F.sum("_c")).alias("error_rate"),
        F.min(F.when(reached, F.col("_l"))).alias("p95"),
    )
    return _flags(report, target, error_limit)

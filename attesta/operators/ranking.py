"""Ranking inside groups, safe where one group holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.governance import display_subject, subject_label
from attesta.functions.text import humanize_event, json_detail, relative_time
from attesta.rules import ACTIVITY_FEED, PHASES, QUICK_ACCESS, SEARCH_LIMIT

BUCKET = 4096


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in the given order, with their rank.

    ``row_number() <= k`` lets Spark cut every map-side partition to ``k`` rows per
    key before the shuffle, so a hot key sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_k_per_query(df: DataFrame, k: int = SEARCH_LIMIT, query: str = "query_id", score: str = "score", id_: str = "point_id") -> DataFrame:
    """Best ``k`` hits per query: score descending, id ascending."""
    return top_per_group(df, [query], [F.col(score).desc(), F.col(id_).asc()], k)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def _joined_on(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    condition = reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[k]) for k in keys])
    return df.join(other, condition, "left").drop(*[other[k] for k in keys])


QUANTILES = 64


def _run_of(df: DataFrame, order: str, bucket: int) -> Column:
    """Number of the run that an order value falls in: it grows with the value, and runs hold about ``bucket`` rows."""
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    rows, bounds = df.agg(F.count(order), F.percentile_approx(F.col(order), at, 20 * QUANTILES)).first()
    if rows <= bucket or bounds is None:
        return F.lit(0).cast("bigint")
    bounds = sorted(set(bounds))
    each = max(1, -(-rows // (bucket * max(1, len(bounds) - 1))))
    value = F.col(order)
    place = reduce(lambda a, b: a + b, [(value >= b).cast("bigint") for b in bounds[1:]], F.lit(0).cast("bigint"))
    table = F.array(*map(F.lit, bounds))
    low = F.element_at(table, (place + 1).cast("int")).cast("double")
    high = F.element_at(table, F.least(place + 2, F.lit(len(bounds))).cast("int")).cast("double")
    share = F.when(high > low, (value.cast("double") - low) / (high - low)).otherwise(0.0)
    inner = F.greatest(F.least(F.floor(share * each), F.lit(each - 1)), F.lit(0))
    return place * F.lit(each) + inner.cast("bigint")


def positions(
    df: DataFrame, keys: list[str], order: str, index: str = "idx", total: str = "n", bucket: int = BUCKET
) -> DataFrame:
    """Zero-based position of every row in its group and the size of the group.

    ``order`` is an integer that is unique in the group and may be sparse. All order values together
    are cut into runs of about ``bucket`` rows: at their quantiles, and evenly between two of these.
    The runs of each group are counted (map-side combined), and only the counts are summed up over the
    whole group. So no task sorts a whole group that is large. Where the values between two
    quantiles are very uneven, a run holds at most 1/64 of all rows.
    """
    run = _run_of(df, order, bucket)
    rows = df.withColumn("_run", run)
    counts = rows.groupBy(*keys, "_run").agg(F.count("*").alias("_size"))
    ordered = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_run",
        F.coalesce(F.sum("_size").over(ordered), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias(total),
    )
    within = Window.partitionBy(*keys, "_run").orderBy(order)
    return (
        _joined_on(rows, offsets, [*keys, "_run"])
        .withColumn(index, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_run", "_offset")
    )


def phase_quartiles(statements: DataFrame, artifact: str = "artifact_id", order: str = "position") -> DataFrame:
    """Statement i of n belongs to phase min(floor(4 i / n), 3) (sizes differ from ntile)."""
    ranked = positions(statements, [artifact], order)
    phase = F.least(F.floor(F.col("idx") * 4 / F.col("n")), F.lit(3)).cast("int")
    names = F.array(*[F.lit(p) for p in PHASES])
    return ranked.withColumn("phase_index", phase).withColumn("phase", F.element_at(names, phase + 1))


def first_chunk_wins(
    chunks: DataFrame,
    source: str = "source_id",
    text: str = "chunk_text",
    order: str = "chunk_index",
    min_len: int = 50,
    hash_: str = "content_hash",
) -> DataFrame:
    """Chunks of at least ``min_len`` characters, one per source and hash: the earliest."""
    hashed = chunks.filter(F.length(text) >= min_len).withColumn(hash_, F.sha2(F.col(text), 256))
    return first_per_group(hashed, [source, hash_], [F.col(order).asc()])


def difficulty_pick(
    statements: DataFrame, requests: DataFrame, artifact: str = "artifact_id", order: str = "position"
) -> DataFrame:
    """Statement chosen per requested difficulty: first, middle or last of the artifact.

    ``requests`` holds (artifact, difficulty) with difficulties Foerder, Basis, Erweiterung.
    """
    ranked = positions(statements, [artifact], order)
    level = F.array_compact(
        F.array(
            F.when(F.col("idx") == 0, F.lit("Foerder")),
            F.when(F.col("idx") == F.floor(F.col("n") / 2), F.lit("Basis")),
            F.when(F.col("idx") == F.col("n") - 1, F.lit("Erweiterung")),
        )
    )
    picked = ranked.withColumn("difficulty", F.explode(level))
    return picked.join(requests.select(artifact, "difficulty").distinct(), [artifact, "difficulty"])


def activity_feed(audit: DataFrame, as_of, k: int = ACTIVITY_FEED) -> DataFrame:
    """Newest audit events per school with a readable title and detail."""
    title = humanize_event("event_type")
    newest = top_per_group(audit, ["school_id"], [F.col("ts").desc(), F.col("event_id").asc()], k)
    return newest.select(
        "school_id",
        "rank",
        "event_id",
        title.alias("title"),
        json_detail("details", F.concat(F.lit("Ereignis: "), title)).alias("detail"),
        F.when(F.col("severity") == "info", F.lit("info")).otherwise(F.lit("warn")).alias("icon"),
        relative_time("ts", F.lit(as_of)).alias("modified"),
    )


def quick_access(strands: DataFrame, k: int = QUICK_ACCESS, tenant: str = "tenant_id") -> DataFrame:
    """First active strands per tenant with their display texts."""
    picked = top_per_group(strands.filter(F.col("status") == "ACTIVE"), [tenant], [F.col("strand_id").asc()], k)
    display = display_subject("subject", "confession_context")
    form = (
        F.when(F.col("education_track") == "GYMNASIALER_BILDUNGSGANG", F.lit("Gymnasialer Bildungsgang"))
        .when(F.col("school_form") == "GESAMTSCHULE", F.lit("Gesamtschule"))
        .otherwise(F.lit("Gemeinschaftsschule"))
    )
    stage = F.when(F.col("school_stage") == "SEK_II", F.lit("Sek II")).otherwise(F.lit("Klassen 5–10"))
    return picked.select(
        tenant,
        "rank",
        "strand_id",
        F.concat(F.lit("Lehrplan "), subject_label(display)).alias("title"),
        F.concat(form, F.lit(" · "), stage).alias("subtitle"),
        F.when(display == "deutsch", F.lit("primary")).otherwise(F.lit("green")).alias("accent"),
    )

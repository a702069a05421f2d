"""Relations between governed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from attesta.functions.governance import (
    display_subject,
    form_ordinal,
    primary_context,
    stored_subject,
    subject_label,
    subject_ordinal,
)
from attesta.functions.text import grade_of_band
from attesta.operators.ranking import first_per_group, top_per_group
from attesta.rules import CONFESSIONS, CURRICULUM_FIT, RECENT_WORK, SCHOOL_FORMS, SUBJECTS
from attesta.session import staged


def resolve_subject(
    sources: DataFrame, links: DataFrame, sheets: DataFrame, units: DataFrame, strands: DataFrame
) -> DataFrame:
    """Display subject per source: own alignment, else the first linked strand, else the default.

    The first link is the one with the smallest sheet id.
    """
    unaligned = sources.filter(F.col("subject").isNull()).select("source_id")
    chain = (
        links.join(unaligned, "source_id", "left_semi")
        .join(sheets.select("sheet_id", "unit_id"), "sheet_id")
        .join(units.select("unit_id", "strand_id"), "unit_id")
        .join(
            strands.select("strand_id", F.col("subject").alias("_s"), F.col("confession_context").alias("_c")),
            "strand_id",
        )
    )
    # min over a struct combines map-side: a source with very many links stays one row per task
    first = chain.groupBy("source_id").agg(F.min(F.struct("sheet_id", "_s", "_c")).alias("_first"))
    own = display_subject("subject", F.coalesce("confession_context", F.lit("NICHT_ANWENDBAR")))
    linked = display_subject(F.col("_first._s"), F.coalesce(F.col("_first._c"), F.lit("NICHT_ANWENDBAR")))
    joined = sources.join(first, "source_id", "left")
    return joined.withColumn(
        "display_subject",
        F.when(F.col("subject").isNotNull(), own).when(F.col("_first").isNotNull(), linked).otherwise(F.lit("deutsch")),
    ).drop("_first")


def latest_draft(
    drafts: DataFrame, submissions: DataFrame, tasks: DataFrame, sheets: DataFrame, units: DataFrame, strands: DataFrame
) -> DataFrame:
    """Newest live draft per owner with its submission and, where known, its teaching context.

    The draft is picked before the context joins, so those see one row per owner.
    """
    live = drafts.filter(F.col("deleted_at").isNull()).join(submissions, "submission_id")
    newest = first_per_group(live, ["owner_id"], [F.col("created_at").desc(), F.col("draft_id").asc()])
    return (
        newest.join(tasks.select("task_id", "sheet_id"), "task_id", "left")
        .join(sheets.select("sheet_id", "unit_id"), "sheet_id", "left")
        .join(units.select("unit_id", "strand_id", "title", "grade_band"), "unit_id", "left")
        .join(strands.select("strand_id", "subject", "confession_context"), "strand_id", "left")
    )


def union_work(units: DataFrame, sheets: DataFrame) -> DataFrame:
    """Units and sheets in one table with their kind; nothing is deduplicated."""
    columns = ["owner_id", "item_id", "title", "grade_band", "updated_at", "strand_id"]
    return (
        units.select(*columns)
        .withColumn("kind", F.lit("unit"))
        .unionByName(sheets.select(*columns).withColumn("kind", F.lit("sheet")))
    )


def recent_work(units: DataFrame, sheets: DataFrame, strands: DataFrame, k: int = RECENT_WORK) -> DataFrame:
    """Newest work items per owner; a unit comes before a sheet of the same time.

    ``units``: unit_id, owner_id, title, grade_band, updated_at, strand_id, deleted_at.
    ``sheets``: sheet_id, unit_id, owner_id, title, updated_at, deleted_at.
    """
    known = strands.select("strand_id", "subject", "confession_context")
    live_units = units.filter(F.col("deleted_at").isNull()).withColumn("item_id", F.col("unit_id"))
    live_sheets = (
        sheets.filter(F.col("deleted_at").isNull())
        .join(units.select("unit_id", "grade_band", "strand_id"), "unit_id")
        .withColumn("item_id", F.col("sheet_id"))
    )
    work = union_work(live_units, live_sheets).join(known.select("strand_id"), "strand_id", "left_semi")
    order = [F.col("updated_at").desc(), (F.col("kind") == "sheet").asc(), F.col("item_id").asc()]
    top = top_per_group(work, ["owner_id"], order, k).join(known, "strand_id")
    display = display_subject("subject", "confession_context")
    kind = F.when(F.col("kind") == "unit", F.lit("Unterrichtseinheit")).otherwise(F.lit("Arbeitsblatt"))
    return top.select(
        "owner_id",
        "rank",
        "kind",
        "item_id",
        "title",
        F.concat(kind, F.lit(" · "), subject_label(display), F.lit(" · "), F.col("grade_band")).alias("subtitle"),
        display.alias("display_subject"),
        "updated_at",
    )


def grants_for(requests: DataFrame, grants: DataFrame, as_of) -> DataFrame:
    """The smallest matching grant per request, null when there is none.

    Equal school and provider, ``as_of`` inside the inclusive validity, and each
    scope list empty or containing the request's value. A request without a
    subject or band is not checked against that list.

    Scopes become lookup keys (a value, "all values", "not asked"), reduced to the
    smallest grant per key. A request then looks up at most four keys, so a school
    with very many requests and grants never meets all its pairs.
    """
    at = F.lit(as_of)
    everything, unasked = F.lit("*"), F.lit("?")

    def offered(scope: str):
        values = F.transform(F.array_distinct(scope), lambda v: F.concat(F.lit("="), v))
        return F.when(F.size(scope) == 0, F.array(everything, unasked)).otherwise(F.array_append(values, unasked))

    def wanted(value: str):
        stated = F.array(F.concat(F.lit("="), value), everything)
        return F.when(F.col(value).isNull(), F.array(unasked)).otherwise(stated)

    keys = ["school_id", "provider", "_subject", "_band"]
    smallest = (
        grants.filter((F.col("valid_from") <= at) & (F.col("valid_until") >= at))
        .select("school_id", "provider", "grant_id", "scope_grade_bands", F.explode(offered("scope_subjects")).alias("_subject"))
        .withColumn("_band", F.explode(offered("scope_grade_bands")))
        .groupBy(*keys)
        .agg(F.min("grant_id").alias("grant_id"))
    )
    matched = (
        requests.select("request_id", "school_id", "provider", "grade_band", F.explode(wanted("subject")).alias("_subject"))
        .withColumn("_band", F.explode(wanted("grade_band")))
        .join(smallest, keys)
        .groupBy("request_id")
        .agg(F.min("grant_id").alias("grant_id"))
    )
    # requests may carry whole texts: those are dealt by id to all tasks, but never sorted
    return requests.join(matched.hint("shuffle_hash"), "request_id", "left")


def resolve_strand(requests: DataFrame, strands: DataFrame) -> DataFrame:
    """Best active strand per request; null strand means the request is blocked.

    Candidate strands are reduced first to one per (subject, context, form), then
    a request picks its own form before the form-independent strand. A request
    with an unknown form may take any form, in declaration order, null last.
    """
    known = F.col("subject").isin(SUBJECTS) & F.col("confession_context").isin(CONFESSIONS)
    active = strands.filter((F.col("status") == "ACTIVE") & known)
    by_form = active.groupBy(
        F.col("subject").alias("_subject"), F.col("confession_context").alias("_context"), F.col("school_form").alias("_form")
    ).agg(F.min("strand_id").alias("_strand"))
    # at most 3 subjects x 5 contexts, each with one entry per form: small whatever the data
    best = by_form.groupBy("_subject", "_context").agg(
        F.array_sort(
            F.collect_list(F.struct(F.coalesce(form_ordinal("_form"), F.lit(9)).alias("o"), F.col("_strand").alias("id")))
        ).alias("_options")
    )
    form = F.upper(F.trim(F.col("school_form")))
    wanted = F.when(form.isin(SCHOOL_FORMS), form_ordinal(form))
    joined = (
        requests.withColumn("_subject", stored_subject("subject"))
        .withColumn("_context", primary_context("subject"))
        .withColumn("_wanted", wanted)
        .join(F.broadcast(best), ["_subject", "_context"], "left")
    )
    fitting = F.filter(
        "_options", lambda o: F.col("_wanted").isNull() | (o["o"] == F.col("_wanted")) | (o["o"] == 9)
    )
    return (
        joined.withColumn("strand_id", F.get(fitting, F.lit(0))["id"])
        .withColumn("strand_context", F.when(F.col("strand_id").isNotNull(), F.col("_context")))
        .drop("_subject", "_context", "_wanted", "_options")
    )


def new_only(candidates: DataFrame, existing: DataFrame, key: str, path: str, metadata: str = "approval_metadata") -> DataFrame:
    """Candidates whose key is not yet in the stored JSON metadata."""
    seen = existing.select(F.get_json_object(metadata, path).alias(key)).filter(F.col(key).isNotNull())
    return candidates.join(seen, key, "left_anti")


def find_duplicates(sources: DataFrame, hash_: str = "content_hash") -> DataFrame:
    """Sources whose content another, earlier source already holds, with that source.

    The holder is found by a map-side combined ``min``, so a content shared by a
    third of all sources still shuffles one row per task.
    """
    holders = (
        sources.filter(F.col(hash_).isNotNull())
        .groupBy(hash_)
        .agg(F.min("source_id").alias("held_by"), F.count("*").alias("_copies"))
        .filter(F.col("_copies") > 1)
        .drop("_copies")
    )
    return sources.join(holders, hash_).filter(F.col("source_id") != F.col("held_by"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    keys = parent.select(F.col(parent_key).alias("_key"))
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_key"), "left_anti")


JUMPS = 3  # joins of a step; each takes the table of the step once more


def curriculum_paths(nodes: DataFrame) -> DataFrame:
    """Every node with its depth and path of codes from the root, within its strand.

    Pointer jumping: a node knows an ancestor and the codes from there down to itself, and
    takes over what that ancestor knows, so each stored step makes the jump four times as long: a
    chain of L nodes takes log4(L) steps. Nodes whose ancestors end at a missing one have no path;
    a cycle raises.
    """
    rows = nodes.select(
        "strand_id",
        "node_id",
        F.col("parent_id").alias("up"),
        F.col("code").alias("path"),
        F.col("parent_id").isNotNull().cast("bigint").alias("depth"),
    )
    for _ in range(nodes.count().bit_length() // 2 + 1):
        known = rows.select(
            "strand_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth")
        )
        for _ in range(JUMPS):
            found = F.col("_depth").isNotNull()
            rows = rows.join(known, ["strand_id", "up"], "left").filter(F.col("up").isNull() | found).select(
                "strand_id",
                "node_id",
                F.when(found, F.col("_up")).alias("up"),
                F.when(found, F.concat("_path", F.lit("/"), "path")).otherwise(F.col("path")).alias("path"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            )
        seen = Observation()
        rows = staged(rows.observe(seen, F.count_if(F.col("up").isNotNull()).alias("open")))
        if not seen.get["open"]:
            return rows.select("strand_id", "node_id", "depth", "path")
    raise ValueError("curriculum tree is cyclic")


def strand_mismatch(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is missing from their own strand."""
    parents = nodes.select("strand_id", F.col("node_id").alias("parent_id"))
    return nodes.filter(F.col("parent_id").isNotNull()).join(parents, ["strand_id", "parent_id"], "left_anti")


def version_heads(versions: DataFrame) -> DataFrame:
    """Root, head (current version) and number of active versions of every chain.

    ``versions``: id, supersedes_id (the version this one replaces), status.
    Pointer doubling: each round a row learns the ancestor of its ancestor, so a
    chain of length L needs log2(L) joins, not L.
    """
    links = versions.select(
        "id",
        F.coalesce("supersedes_id", "id").alias("root"),
        F.col("supersedes_id").isNotNull().cast("bigint").alias("position"),
    )
    for _ in range(versions.count().bit_length() + 2):
        up = links.select(F.col("id").alias("root"), F.col("root").alias("_next"), F.col("position").alias("_more"))
        moved = links.join(up, "root", "left").select(
            "id",
            F.coalesce("_next", "root").alias("root"),
            (F.col("position") + F.coalesce("_more", F.lit(0))).alias("position"),
            (~F.col("_next").eqNullSafe(F.col("root")) & F.col("_next").isNotNull()).alias("_moved"),
        )
        moved = staged(moved)
        links = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    else:
        raise ValueError("version chain is cyclic")
    # a pointer that came back to its own row closed a circle
    replacing = versions.filter(F.col("supersedes_id").isNotNull()).select("id")
    if not links.filter(F.col("id") == F.col("root")).join(replacing, "id", "left_semi").isEmpty():
        raise ValueError("version chain is cyclic")
    joined = links.join(versions.select("id", "status"), "id")
    return joined.groupBy("root").agg(
        F.max_by("id", F.struct("position", "id")).alias("head"),
        F.count("*").alias("versions"),
        F.count_if(F.col("status") == "ACTIVE").alias("active"),
        (F.count_if(F.col("status") == "ACTIVE") > 1).alias("conflict"),
    )


def dangling_links(pages: DataFrame, targets: DataFrame, link_pattern: str = r"\[[^\]]*\]\(([^)]+)\)", text: str = "text") -> DataFrame:
    """Internal links whose target is unknown; code, anchors and external links do not count."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"```[\s\S]*?```", ""), "`[^`]*`", "")
    found = pages.select("page_id", F.explode(F.regexp_extract_all(body, F.lit(link_pattern), F.lit(1))).alias("_raw"))
    raw = F.trim("_raw")
    internal = found.filter((raw != "") & ~raw.rlike(r"(?i)^(https?:|mailto:|tel:|#)"))
    cut = internal.select("page_id", F.regexp_extract(raw, r"^[^#?\s]*", 0).alias("target")).filter(F.col("target") != "")
    return cut.join(targets.select("target"), "target", "left_anti")


def curriculum_fit(strands: DataFrame, nodes: DataFrame, k: int = CURRICULUM_FIT) -> DataFrame:
    """First nodes by code of every active strand, with the strand as source hint."""
    active = strands.filter(F.col("status") == "ACTIVE").select("strand_id", "authority", "version")
    known = nodes.join(active.select("strand_id"), "strand_id", "left_semi")
    top = top_per_group(known, ["strand_id"], [F.col("code").asc(), F.col("node_id").asc()], k)
    return top.join(active, "strand_id").select(
        "strand_id",
        "rank",
        "node_id",
        F.col("title").alias("label"),
        F.coalesce("description", "competence_area", F.lit("Kompetenzbereich des Lehrplans")).alias("detail"),
        F.concat("authority", F.lit(", "), "version").alias("source_hint"),
    )


def claims_on_revoked(provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """(artifact, source) pairs where the cited source is revoked."""
    revoked = sources.filter(F.col("lifecycle_status") == "REVOKED").select("source_id")
    cited = provenance.select("artifact_id", F.explode("source_refs").alias("source_id"))
    return cited.join(revoked, "source_id", "left_semi")


def default_context(tenants: DataFrame, strands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Preset subject, form and grade band per tenant from its first active strand.

    ``strands`` carries tenant_id. Order: subject declaration, then strand id.
    """
    active = strands.filter(F.col("status") == "ACTIVE")
    first = first_per_group(active, ["tenant_id"], [subject_ordinal("subject").asc(), F.col("strand_id").asc()])
    # bands sort by declaration: KS5 ... KS10
    band_order = F.regexp_replace("grade_band", "[^0-9]", "").try_cast("int")
    bands = nodes.filter(F.col("grade_band").isNotNull()).groupBy("strand_id").agg(
        F.min_by("grade_band", band_order).alias("grade_band")
    )
    joined = tenants.join(first, "tenant_id", "left").join(bands, "strand_id", "left")
    known = F.col("strand_id").isNotNull()
    form = F.when(
        F.col("education_track") == "GYMNASIALER_BILDUNGSGANG", F.lit("gymnasialer-bildungsgang")
    ).otherwise(F.lit("gemeinschaftsschule"))
    return joined.select(
        "tenant_id",
        F.when(known, display_subject("subject", "confession_context")).otherwise(F.lit("deutsch")).alias("subject"),
        F.when(known, form).otherwise(F.lit("gemeinschaftsschule")).alias("school_form"),
        grade_of_band("grade_band").alias("grade"),
    )

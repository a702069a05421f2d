"""Registered queries: joins and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.core import query
from attesta.catalog.q_sources import GROUNDED_SQL, grounded
from attesta.catalog.views import AS_OF
from attesta.functions.vectors import cosine
from attesta.operators import grounding, joins, retention, search
from attesta.operators.ranking import difficulty_pick, top_k_per_query


@query(
    "hit_source_join",
    """SELECT p.point_id, s.title, s.license_info, s.publisher FROM (SELECT point_id, source_id FROM {v_point}) p
       JOIN {v_source} s ON s.source_id = p.source_id WHERE s.deleted_at IS NULL""",
)
def _(t):
    known = t("v_source").filter(F.col("deleted_at").isNull())
    return search.with_source(t("v_point").select("point_id", "source_id"), known).select(
        "point_id", "title", "license_info", "publisher"
    )


_DISPLAY = """CASE WHEN {s} = 'DEUTSCH' THEN 'deutsch' WHEN {s} = 'ETHIK' THEN 'ethik'
              WHEN {c} = 'KATHOLISCH' THEN 'katholische-religion' ELSE 'evangelische-religion' END"""


def _display(s: str, c: str) -> str:
    return _DISPLAY.replace("{s}", s).replace("{c}", c)


@query(
    "subject_resolution",
    f"""
    SELECT s.source_id, CASE WHEN s.subject IS NOT NULL THEN {_display('s.subject', 's.confession_context')}
                             WHEN f.fs IS NOT NULL THEN {_display('f.fs', 'f.fc')} ELSE 'deutsch' END AS display_subject
    FROM {{v_supplied}} s LEFT JOIN (
      SELECT l.source_id, st.subject AS fs, st.confession_context AS fc,
             row_number() OVER (PARTITION BY l.source_id ORDER BY l.sheet_id) AS rn
      FROM {{v_link}} l JOIN {{v_sheet}} w ON w.sheet_id = l.sheet_id JOIN {{v_unit}} u ON u.unit_id = w.unit_id
      JOIN {{v_strand}} st ON st.strand_id = u.strand_id) f ON f.source_id = s.source_id AND f.rn = 1
    """,
)
def _(t):
    return joins.resolve_subject(t("v_supplied"), t("v_link"), t("v_sheet"), t("v_unit"), t("v_strand")).select(
        "source_id", "display_subject"
    )


@query(
    "latest_draft",
    """
    SELECT owner_id, draft_id, status, pseudonym, title, grade_band, subject FROM (
      SELECT d.owner_id, d.draft_id, d.status, s.pseudonym, u.title, u.grade_band, st.subject,
             row_number() OVER (PARTITION BY d.owner_id ORDER BY d.created_at DESC, d.draft_id) AS rn
      FROM {v_draft} d JOIN {v_submission} s ON s.submission_id = d.submission_id
      LEFT JOIN {v_task} k ON k.task_id = s.task_id LEFT JOIN {v_sheet} w ON w.sheet_id = k.sheet_id
      LEFT JOIN {v_unit} u ON u.unit_id = w.unit_id LEFT JOIN {v_strand} st ON st.strand_id = u.strand_id
      WHERE d.deleted_at IS NULL) WHERE rn = 1
    """,
)
def _(t):
    drafts = t("v_draft")
    submissions = t("v_submission").select("submission_id", "task_id", "pseudonym")
    return joins.latest_draft(drafts, submissions, t("v_task"), t("v_sheet"), t("v_unit"), t("v_strand")).select(
        "owner_id", "draft_id", "status", "pseudonym", "title", "grade_band", "subject"
    )


_WORK_SQL = """
    SELECT owner_id, unit_id AS item_id, title, grade_band, updated_at, strand_id, 'unit' AS kind FROM {v_unit} WHERE deleted_at IS NULL
    UNION ALL
    SELECT w.owner_id, w.sheet_id, w.title, u.grade_band, w.updated_at, u.strand_id, 'sheet'
    FROM {v_sheet} w JOIN {v_unit} u ON u.unit_id = w.unit_id WHERE w.deleted_at IS NULL
"""


@query(
    "recent_work",
    f"""
    SELECT owner_id, rank, kind, item_id, title, CASE kind WHEN 'unit' THEN 'Unterrichtseinheit' ELSE 'Arbeitsblatt' END || ' · ' ||
           CASE d WHEN 'deutsch' THEN 'Deutsch' WHEN 'ethik' THEN 'Ethik' WHEN 'katholische-religion' THEN 'Kath. Religion' ELSE 'Ev. Religion' END
           || ' · ' || grade_band AS subtitle
    FROM (SELECT x.*, {_display('s.subject', 's.confession_context')} AS d,
                 row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, CASE kind WHEN 'unit' THEN 0 ELSE 1 END, item_id) AS rank
          FROM ({_WORK_SQL}) x JOIN {{v_strand}} s ON s.strand_id = x.strand_id)
    WHERE rank <= 4
    """,
)
def _(t):
    return joins.recent_work(t("v_unit"), t("v_sheet"), t("v_strand")).select(
        "owner_id", F.col("rank").cast("bigint").alias("rank"), "kind", "item_id", "title", "subtitle"
    )


@query("union_work", f"SELECT kind, owner_id, count(*) AS n FROM ({_WORK_SQL}) GROUP BY 1, 2")
def _(t):
    units = t("v_unit").filter(F.col("deleted_at").isNull()).withColumn("item_id", F.col("unit_id"))
    sheets = (
        t("v_sheet")
        .filter(F.col("deleted_at").isNull())
        .join(t("v_unit").select("unit_id", "grade_band", "strand_id"), "unit_id")
        .withColumn("item_id", F.col("sheet_id"))
    )
    return joins.union_work(units, sheets).groupBy("kind", "owner_id").agg(F.count("*").alias("n"))


@query(
    "active_grant",
    f"""
    SELECT r.request_id, min(g.grant_id) AS grant_id FROM {{v_request}} r LEFT JOIN {{v_grant}} g
      ON g.school_id = r.school_id AND g.provider = r.provider AND TIMESTAMP '{AS_OF}' BETWEEN g.valid_from AND g.valid_until
     AND (len(g.scope_subjects) = 0 OR list_contains(g.scope_subjects, r.subject))
     AND (len(g.scope_grade_bands) = 0 OR list_contains(g.scope_grade_bands, r.grade_band))
    GROUP BY r.request_id
    """,
)
def _(t):
    return joins.grants_for(t("v_request"), t("v_grant"), F.lit(AS_OF).cast("timestamp_ntz")).select(
        "request_id", "grant_id"
    )


@query(
    "strand_resolution",
    """
    SELECT request_id, strand_id FROM (
      SELECT r.request_id, s.strand_id, row_number() OVER (PARTITION BY r.request_id
               ORDER BY CASE s.school_form WHEN 'GESAMTSCHULE' THEN 0 WHEN 'GEMEINSCHAFTSSCHULE' THEN 1 ELSE 2 END, s.strand_id) AS rn
      FROM (SELECT *, upper(trim(school_form)) AS form,
                   CASE subject WHEN 'deutsch' THEN 'DEUTSCH' WHEN 'ethik' THEN 'ETHIK' ELSE 'RELIGION' END AS db_subject,
                   CASE subject WHEN 'deutsch' THEN 'NICHT_ANWENDBAR' WHEN 'ethik' THEN 'RELIGIONSKUNDLICH'
                        WHEN 'katholische-religion' THEN 'KATHOLISCH' ELSE 'EVANGELISCH' END AS context FROM {v_request}) r
      LEFT JOIN {v_strand} s ON s.status = 'ACTIVE' AND s.subject = r.db_subject AND s.confession_context = r.context
        AND (form NOT IN ('GESAMTSCHULE', 'GEMEINSCHAFTSSCHULE') OR s.school_form = form OR s.school_form IS NULL))
    WHERE rn = 1
    """,
)
def _(t):
    return joins.resolve_strand(t("v_request"), t("v_strand")).select("request_id", "strand_id")


@query(
    "new_only",
    """SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {v_source} s
         WHERE s.approval_metadata = '{{"ingestKey":"key-' || cast(d.doc_id AS string) || '"}}')""",
)
def _(t):
    candidates = t("documents").select("doc_id", F.concat(F.lit("key-"), F.col("doc_id").cast("string")).alias("ingest_key"))
    return joins.new_only(candidates, t("v_source"), "ingest_key", "$.ingestKey").select("doc_id")


@query(
    "duplicate_source",
    """SELECT source_id, held_by FROM (SELECT source_id, min(source_id) OVER (PARTITION BY content_hash) AS held_by FROM {v_source})
       WHERE source_id <> held_by""",
)
def _(t):
    return joins.find_duplicates(t("v_source").select("source_id", "content_hash")).select("source_id", "held_by")


@query(
    "ground_statements",
    f"""
    WITH {GROUNDED_SQL}
    SELECT g.artifact_id, g.position, g.confidence, coalesce(string_agg(cast(c.source_id AS string), ',' ORDER BY c.place), '') AS cited
    FROM grounded g LEFT JOIN cited c USING (artifact_id, position) GROUP BY 1, 2, 3
    """,
)
def _(t):
    return grounded(t).select(
        "artifact_id", "position", "confidence", F.array_join("citations.source_id", ",").alias("cited")
    )


@query("similarity_search", "SELECT query_id, rank, point_id, round(score, 6) AS score FROM {v_hit}")
def _(t):
    hits = search.search(search.query_filters(t("v_query")), t("v_point"), limit=15)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "point_id", F.round("score", 6).alias("score"))


@query(
    "top_k_per_query",
    """SELECT label, rank, doc_id, score FROM (
         SELECT quality AS label, doc_id, round(n_chars / 1000.0, 3) AS score,
                row_number() OVER (PARTITION BY quality ORDER BY round(n_chars / 1000.0, 3) DESC, doc_id) AS rank
         FROM {documents} JOIN {labels} USING (doc_id)) WHERE rank <= 10""",
)
def _(t):
    scored = t("documents").join(t("labels"), "doc_id").select(
        F.col("quality").alias("label"), "doc_id", F.round(F.col("n_chars") / 1000.0, 3).alias("score")
    )
    top = top_k_per_query(scored, 10, query="label", id_="doc_id")
    return top.select("label", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


@query(
    "cosine",
    """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.vector), 6) AS score
       FROM {embeddings} e JOIN {v_query} q ON q.query_id = e.label * 4 + e.vec_id % 4""",
)
def _(t):
    e = t("embeddings").withColumn("query_id", F.col("label") * 4 + F.col("vec_id") % 4)
    return e.join(t("v_query").select("query_id", "vector"), "query_id").select(
        "vec_id", F.round(cosine("embedding", "vector"), 6).alias("score")
    )


def _mmr_rounds(hits: str, k: int) -> str:
    """Greedy rounds as common tables: p<i> holds the picks after round i."""
    parts = [f"p0 AS (SELECT query_id, point_id, vector, 0 AS mmr_rank, score FROM {hits} WHERE false)"]
    for i in range(1, k + 1):
        parts.append(
            f"""p{i} AS (SELECT * FROM p{i - 1} UNION ALL
              SELECT query_id, point_id, vector, {i}, score FROM (
                SELECT h.query_id, h.point_id, h.vector, h.score, row_number() OVER (PARTITION BY h.query_id ORDER BY
                    0.7::double * h.score - (1.0::double - 0.7::double) * greatest(0.0, coalesce(max(list_cosine_similarity(h.vector::double[], p.vector::double[])), 0.0)) DESC,
                    h.rank) AS rn
                FROM {hits} h LEFT JOIN p{i - 1} p ON p.query_id = h.query_id
                WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} d WHERE d.query_id = h.query_id AND d.point_id = h.point_id)
                GROUP BY h.query_id, h.point_id, h.vector, h.score, h.rank) WHERE rn = 1)"""
        )
    return ",\n".join(parts)


@query(
    "mmr_rerank",
    f"WITH h AS MATERIALIZED (SELECT * FROM {{v_hit}}), {_mmr_rounds('h', 5)} SELECT query_id, mmr_rank, point_id, round(score, 6) AS score FROM p5",
)
def _(t):
    picked = search.mmr_rerank(t("v_hit"), 5)
    return picked.select("query_id", "mmr_rank", "point_id", F.round("score", 6).alias("score"))


@query(
    "orphan_check",
    """
    SELECT 'chunk' AS kind, chunk_id AS child FROM {v_chunk} WHERE source_id NOT IN (SELECT source_id FROM {v_source} WHERE deleted_at IS NULL)
    UNION ALL SELECT 'draft', cast(draft_id AS string) FROM {v_draft} WHERE submission_id NOT IN (SELECT submission_id FROM {v_submission})
    UNION ALL SELECT 'link', cast(sheet_id AS string) || '|' || cast(source_id AS string) FROM {v_link} WHERE sheet_id NOT IN (SELECT sheet_id FROM {v_sheet} WHERE deleted_at IS NULL)
    """,
)
def _(t):
    alive = t("v_source").filter(F.col("deleted_at").isNull())
    sheets = t("v_sheet").filter(F.col("deleted_at").isNull())
    chunk = joins.orphans(t("v_chunk").select("chunk_id", "source_id"), alive, "source_id", "source_id")
    draft = joins.orphans(t("v_draft"), t("v_submission"), "submission_id", "submission_id")
    link = joins.orphans(t("v_link"), sheets, "sheet_id", "sheet_id")
    return (
        chunk.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("child"))
        .unionByName(draft.select(F.lit("draft").alias("kind"), F.col("draft_id").cast("string").alias("child")))
        .unionByName(link.select(F.lit("link").alias("kind"), F.concat_ws("|", F.col("sheet_id").cast("string"), F.col("source_id").cast("string")).alias("child")))
    )


_DIFFICULTIES_SQL = "SELECT DISTINCT artifact_id, CASE artifact_id % 3 WHEN 0 THEN 'Foerder' WHEN 1 THEN 'Basis' ELSE 'Erweiterung' END AS difficulty FROM {v_statement}"


def difficulties(t):
    level = F.when(F.col("artifact_id") % 3 == 0, F.lit("Foerder")).when(F.col("artifact_id") % 3 == 1, F.lit("Basis")).otherwise(F.lit("Erweiterung"))
    return t("v_statement").select("artifact_id", level.alias("difficulty")).distinct()


_PICK_SQL = f"""
    ranked AS (SELECT artifact_id, position, row_number() OVER (PARTITION BY artifact_id ORDER BY position) - 1 AS idx,
                      count(*) OVER (PARTITION BY artifact_id) AS n FROM {{v_statement}}),
    picks AS (SELECT r.artifact_id, d.difficulty, r.position FROM ranked r JOIN ({_DIFFICULTIES_SQL}) d ON d.artifact_id = r.artifact_id
              AND r.idx = CASE d.difficulty WHEN 'Foerder' THEN 0 WHEN 'Basis' THEN n // 2 ELSE n - 1 END)
"""


@query(
    "link_tables",
    f"""
    WITH {GROUNDED_SQL}, {_PICK_SQL}
    SELECT DISTINCT 'sheet' AS kind, artifact_id AS worksheet_id, source_id FROM cited
    UNION ALL SELECT DISTINCT 'task-' || p.difficulty, p.artifact_id, c.source_id FROM picks p JOIN cited c USING (artifact_id, position)
    """,
)
def _(t):
    sheets, tasks = grounding.build_links(grounded(t), difficulties(t))
    return sheets.select(F.lit("sheet").alias("kind"), "worksheet_id", "source_id").unionByName(
        tasks.select(F.concat(F.lit("task-"), "difficulty").alias("kind"), "worksheet_id", "source_id")
    )


@query("difficulty_pick", f"WITH {_PICK_SQL} SELECT artifact_id, difficulty, position FROM picks")
def _(t):
    return difficulty_pick(t("v_statement"), difficulties(t)).select("artifact_id", "difficulty", "position")


@query(
    "curriculum_paths",
    """
    WITH RECURSIVE tree AS (
      SELECT strand_id, node_id, cast(0 AS bigint) AS depth, code AS path FROM {v_node} WHERE parent_id IS NULL
      UNION ALL
      SELECT n.strand_id, n.node_id, tree.depth + 1, tree.path || '/' || n.code
      FROM {v_node} n JOIN tree ON tree.node_id = n.parent_id AND tree.strand_id = n.strand_id)
    SELECT strand_id, node_id, depth, path FROM tree
    """,
)
def _(t):
    return joins.curriculum_paths(t("v_node"))


@query(
    "strand_mismatch",
    """SELECT node_id, strand_id, parent_id FROM {v_strand_node} n WHERE parent_id IS NOT NULL AND NOT EXISTS
         (SELECT 1 FROM {v_strand_node} p WHERE p.node_id = n.parent_id AND p.strand_id = n.strand_id)""",
)
def _(t):
    return joins.strand_mismatch(t("v_strand_node")).select("node_id", "strand_id", "parent_id")


@query(
    "version_chain",
    """
    WITH RECURSIVE chain AS (
      SELECT id AS root, id, status, cast(0 AS bigint) AS position FROM {v_version} WHERE supersedes_id IS NULL
      UNION ALL SELECT chain.root, v.id, v.status, chain.position + 1 FROM {v_version} v JOIN chain ON v.supersedes_id = chain.id)
    SELECT root, max_by(id, position) AS head, count(*) AS versions, count(*) FILTER (status = 'ACTIVE') AS active,
           count(*) FILTER (status = 'ACTIVE') > 1 AS conflict FROM chain GROUP BY root
    """,
)
def _(t):
    return joins.version_heads(t("v_version"))


_GONE = "SELECT unit_id FROM {v_unit} WHERE deleted_at IS NOT NULL"


@query(
    "cascade_plan",
    f"""
    WITH sh AS (SELECT sheet_id, unit_id FROM {{v_sheet}} WHERE unit_id IN ({_GONE})),
         tk AS (SELECT k.task_id, sh.unit_id FROM {{v_task}} k JOIN sh USING (sheet_id)),
         sb AS (SELECT s.submission_id, tk.unit_id FROM {{v_submission}} s JOIN tk USING (task_id)),
         al AS (SELECT 'teaching_unit' AS "table", cast(unit_id AS string) AS row_id, 'delete' AS a, unit_id FROM ({_GONE})
                UNION ALL SELECT 'worksheet', cast(sheet_id AS string), 'delete', unit_id FROM sh
                UNION ALL SELECT 'task', cast(task_id AS string), 'delete', unit_id FROM tk
                UNION ALL SELECT 'student_submission', cast(submission_id AS string), 'restrict', unit_id FROM sb
                UNION ALL SELECT 'correction_draft', cast(d.draft_id AS string), 'keep', sb.unit_id FROM {{v_draft}} d JOIN sb USING (submission_id))
    SELECT "table", row_id, CASE WHEN a = 'delete' AND unit_id IN (SELECT unit_id FROM sb) THEN 'blocked' ELSE a END AS action, unit_id FROM al
    """,
)
def _(t):
    gone = t("v_unit").filter(F.col("deleted_at").isNotNull())
    return retention.cascade_plan(
        gone, t("v_unit"), t("v_sheet"), t("v_task"), t("v_submission").select("submission_id", "task_id"), t("v_draft")
    )


@query(
    "strand_cascade",
    """
    WITH g AS (SELECT strand_id FROM {v_strand} WHERE status = 'RETIRED'),
         nd AS (SELECT node_id, strand_id FROM {v_strand_node} WHERE strand_id IN (SELECT strand_id FROM g)),
         un AS (SELECT unit_id, strand_id FROM {v_unit} WHERE strand_id IN (SELECT strand_id FROM g)),
         al AS (SELECT 'curriculum_strand' AS "table", cast(strand_id AS string) AS row_id, 'delete' AS a, strand_id FROM g
                UNION ALL SELECT 'curriculum_node', cast(node_id AS string), 'delete', strand_id FROM nd
                UNION ALL SELECT 'task', cast(k.task_id AS string), 'set-null', nd.strand_id FROM {v_task} k JOIN nd USING (node_id)
                UNION ALL SELECT 'teaching_unit', cast(unit_id AS string), 'restrict', strand_id FROM un)
    SELECT "table", row_id, CASE WHEN a <> 'restrict' AND strand_id IN (SELECT strand_id FROM un) THEN 'blocked' ELSE a END AS action, strand_id FROM al
    """,
)
def _(t):
    gone = t("v_strand").filter(F.col("status") == "RETIRED")
    return retention.strand_cascade(gone, t("v_strand"), t("v_strand_node"), t("v_unit"), t("v_task"))


@query(
    "dangling_links",
    f"""
    SELECT page_id, target, count(*) AS n FROM (
      SELECT page_id, regexp_extract(raw, '^[^#?\\s]*') AS target FROM (
        SELECT page_id, trim(unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, 'href="([^"]*)"', '[link](\\1)', 'g'), '```[\\s\\S]*?```', '', 'g'), '`[^`]*`', '', 'g'), '\\[[^\\]]*\\]\\(([^)]+)\\)', 1))) AS raw
        FROM {{pages}}) WHERE raw <> '' AND NOT regexp_matches(raw, '(?i)^(https?:|mailto:|tel:|#)'))
    WHERE target <> '' AND target NOT IN (SELECT regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) FROM {{pages}})
    GROUP BY page_id, target
    """,
)
def _(t):
    targets = t("pages").select(F.regexp_extract("url", r"^https?://[^/]*(/[^?#]*)", 1).alias("target")).distinct()
    # the pages are HTML: their links are written the way the operator's default pattern reads them
    linked = F.regexp_replace("html", 'href="([^"]*)"', "[link]($1)")
    pages = t("pages").select("page_id", linked.alias("text"))
    return joins.dangling_links(pages, targets).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(
    "curriculum_fit",
    """
    SELECT strand_id, rank, node_id, label, detail, source_hint FROM (
      SELECT s.strand_id, n.node_id, n.title AS label, coalesce(n.description, n.competence_area, 'Kompetenzbereich des Lehrplans') AS detail,
             s.authority || ', ' || s.version AS source_hint, row_number() OVER (PARTITION BY s.strand_id ORDER BY n.code, n.node_id) AS rank
      FROM {v_strand} s JOIN {v_strand_node} n ON n.strand_id = s.strand_id WHERE s.status = 'ACTIVE') WHERE rank <= 6
    """,
)
def _(t):
    return joins.curriculum_fit(t("v_strand"), t("v_strand_node")).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "claims_on_revoked",
    f"""WITH {GROUNDED_SQL} SELECT DISTINCT c.artifact_id, c.source_id FROM cited c JOIN {{v_source}} s USING (source_id) WHERE s.lifecycle_status = 'REVOKED'""",
)
def _(t):
    trail = grounding.cited_sources(grounded(t)).withColumnRenamed("source_ids", "source_refs")
    return joins.claims_on_revoked(trail, t("v_source")).select("artifact_id", "source_id")


@query(
    "default_context",
    """
    SELECT tenant_id, coalesce(subject, 'deutsch') AS subject, coalesce(school_form, 'gemeinschaftsschule') AS school_form,
           cast(coalesce(cast(substring(band, 3) AS int), 8) AS int) AS grade
    FROM (SELECT DISTINCT cast(c_nationkey AS bigint) AS tenant_id FROM {customer}) LEFT JOIN (
      SELECT tenant_id, CASE WHEN s.subject = 'DEUTSCH' THEN 'deutsch' WHEN s.subject = 'ETHIK' THEN 'ethik'
                WHEN confession_context = 'KATHOLISCH' THEN 'katholische-religion' ELSE 'evangelische-religion' END AS subject,
             CASE WHEN education_track = 'GYMNASIALER_BILDUNGSGANG' THEN 'gymnasialer-bildungsgang' ELSE 'gemeinschaftsschule' END AS school_form,
             (SELECT 'KS' || cast(min(cast(substring(grade_band, 3) AS int)) AS string) FROM {v_strand_node} n WHERE n.strand_id = s.strand_id) AS band,
             row_number() OVER (PARTITION BY tenant_id ORDER BY CASE s.subject WHEN 'DEUTSCH' THEN 0 WHEN 'RELIGION' THEN 1 ELSE 2 END, strand_id) AS rn
      FROM {v_strand} s WHERE status = 'ACTIVE') USING (tenant_id) WHERE coalesce(rn, 1) = 1
    """,
)
def _(t):
    tenants = t("customer").select(F.col("c_nationkey").cast("bigint").alias("tenant_id")).distinct()
    return joins.default_context(tenants, t("v_strand"), t("v_strand_node"))


@query(
    "registry_minus_index",
    "SELECT source_id FROM {v_source} WHERE deleted_at IS NULL AND source_id NOT IN (SELECT source_id FROM {v_chunk})",
)
def _(t):
    registered = t("v_source").filter(F.col("deleted_at").isNull()).select("source_id")
    return registered.join(t("v_chunk").select("source_id"), "source_id", "left_anti")

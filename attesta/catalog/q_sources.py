"""Registered queries: scans, writes, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.core import query
from attesta.catalog.dialect import GUARD_CASE
from attesta.catalog.views import AS_OF
from attesta.functions import governance as gov
from attesta.functions.hooks import extract_hook
from attesta.functions.privacy import residual_pattern
from attesta.operators import filters, grounding, lifecycle, search
from attesta.session import stage_folder
from attesta.sources import audit, chunks, corpus, registry


@query(
    "live_sources",
    "SELECT source_id, trust_level, lifecycle_status FROM {v_source} WHERE deleted_at IS NULL",
)
def _(t):
    return filters.live(t("v_source")).select("source_id", "trust_level", "lifecycle_status")


@query(
    "corpus_listing",
    """SELECT rel_path FROM {v_path}
       WHERE split_part(rel_path, '/', 1) IN ('2_Deutsch', '3_Religion', 'Materialsammlung-RAG')""",
)
def _(t):
    return corpus.narrow(t("v_path"), ["2_Deutsch", "3_Religion", "Materialsammlung-RAG"]).select("rel_path")


_FOLDERS = ["2_Deutsch", "3_Religion", "Materialsammlung-RAG", "Privat"]


@query(
    "corpus_files",
    """
    SELECT folder, sum(strlen(html) + 1)::bigint AS bytes, sum(length(html) + 1)::bigint AS characters, false AS failed FROM (
      SELECT html, CASE page_id % 4 WHEN 0 THEN '2_Deutsch' WHEN 1 THEN '3_Religion' WHEN 2 THEN 'Materialsammlung-RAG' ELSE 'Privat' END AS folder FROM {pages})
    WHERE folder <> 'Privat' GROUP BY folder
    """,
)
def _(t):
    """Pages written as files below four folders; the allowed ones are listed, read and decoded."""
    root = f"{stage_folder(t.spark)}/corpus"
    for i, folder in enumerate(_FOLDERS):
        t("pages").filter(F.col("page_id") % 4 == i).select("html").write.text(f"{root}/{folder}/pages")
    files = corpus.list_corpus(t.spark, root, [*_FOLDERS[:3], "missing"], with_content=True)
    named = files.select(
        F.substring_index("rel_path", "/", 1).alias("folder"), "length", "content", F.lit("text/html").alias("mime")
    )
    out = extract_hook(named, lambda: lambda payload, mime: payload.decode("utf-8"))
    failed = F.col("extract_error").isNotNull() & (F.col("length") > 0)
    return out.groupBy("folder").agg(
        F.sum("length").alias("bytes"), F.coalesce(F.sum(F.length("extracted_text")), F.lit(0)).alias("characters"), F.max(failed).alias("failed")
    )


_REGISTRY_SQL = """
SELECT entry_id, 
       CASE WHEN lower(trust_level) = 'official' AND lower(source_type) IN ('framework', 'law', 'curriculum') THEN 'OFFICIAL_BINDING'
            WHEN lower(source_type) = 'guidance' THEN 'OFFICIAL_GUIDANCE' ELSE 'UNVERIFIED' END AS trust_level,
       CASE WHEN upper(subject) IN ('DEUTSCH', 'ETHIK', 'RELIGION') THEN upper(subject)
            WHEN upper(subject) IN ('RELIGION_EV', 'RELIGION_KA') THEN 'RELIGION' END AS subject,
       CASE upper(subject) WHEN 'DEUTSCH' THEN 'NICHT_ANWENDBAR' WHEN 'ETHIK' THEN 'RELIGIONSKUNDLICH'
            WHEN 'RELIGION_EV' THEN 'EVANGELISCH' WHEN 'RELIGION_KA' THEN 'KATHOLISCH'
            WHEN 'RELIGION' THEN 'KONFESSIONSSENSIBEL_UEBERGREIFEND' END AS confession_context
FROM {v_registry}"""


@query("registry_map", _REGISTRY_SQL)
def _(t):
    return registry.map_registry(t("v_registry")).select("entry_id", "trust_level", "subject", "confession_context")


@query(
    "registry_load",
    f"""SELECT *, 'DISCOVERED' AS lifecycle_status, false AS license_verified FROM ({_REGISTRY_SQL})
        WHERE entry_id NOT IN (SELECT replace(replace(approval_metadata, '{{{{"sourceSeedId":"', ''), '"}}}}', '') FROM {{v_imported}})""",
)
def _(t):
    return registry.load_registry(t("v_registry"), t("v_imported")).select(
        "entry_id", "trust_level", "subject", "confession_context", "lifecycle_status", "license_verified"
    )


@query(
    "golden_question_load",
    """
    SELECT cast(doc_id AS string) AS id,
           concat_ws(',', CASE WHEN doc_id % 4 = 3 THEN 'domain' END, CASE WHEN lang = 'fr' THEN 'confession_context' END,
                     CASE WHEN doc_id % 9 = 0 THEN 'grade_range' END, CASE WHEN trim(text) = '' THEN 'query' END,
                     CASE WHEN doc_id % 6 = 0 THEN 'expected_source_ids' END, CASE WHEN doc_id % 10 = 5 THEN 'status' END) AS errors
    FROM {documents}
    """,
)
def _(t):
    raw = t("documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 4 == 3, F.lit("Deutsch")).otherwise(F.lit("DEUTSCH")).alias("domain"),
        F.when(F.col("lang") == "fr", F.lit("neutral")).otherwise(F.lit("evangelisch")).alias("confession_context"),
        F.col("source").alias("competence_area"),
        F.when(F.col("doc_id") % 9 == 0, F.lit("  ")).otherwise(F.lit("5-6")).alias("grade_range"),
        F.col("text").alias("query"),
        F.when(F.col("doc_id") % 6 == 0, F.array(F.col("source"), F.lit(None).cast("string")))
        .otherwise(F.array("source"))
        .alias("expected_source_ids"),
        F.lit("S. 1").alias("expected_section"),
        F.col("lang").alias("rationale"),
        F.when(F.col("doc_id") % 10 == 5, F.lit(None).cast("string")).otherwise(F.lit("active")).alias("status"),
    )
    valid, rejects = registry.validate_questions(raw)
    return valid.select("id", F.lit("").alias("errors")).unionByName(
        rejects.select("id", F.array_join("errors", ",").alias("errors"))
    )


@query(
    "blob_layout",
    """SELECT source_id, 'sources/' || cast(source_id AS string) || '/v' || cast(source_version AS string) AS blob_key FROM {v_source}""",
)
def _(t):
    return t("v_source").select("source_id", gov.blob_key("source_id", "source_version").alias("blob_key"))


@query(
    "mime_route",
    """SELECT mime, count(*) AS n FROM (
         SELECT CASE WHEN u LIKE '%.pdf' THEN 'application/pdf' WHEN u LIKE '%.html' OR u LIKE '%.htm' THEN 'text/html'
                     WHEN u LIKE '%.txt' OR u LIKE '%.md' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime
         FROM (SELECT lower(split_part(uri, '?', 1)) AS u FROM {v_source}
               UNION ALL SELECT lower(split_part(url, '?', 1)) FROM {pages}))
       GROUP BY mime""",
)
def _(t):
    uris = t("v_source").select("uri").unionByName(t("pages").select(F.col("url").alias("uri")))
    return uris.groupBy(gov.mime_of("uri").alias("mime")).agg(F.count("*").alias("n"))


@query(
    "chunk_upsert",
    """
    WITH d AS (SELECT vec_id * 2 AS point_id, 'USER_APPROVED' AS trust_level, 1 AS batch FROM {embeddings}
               UNION ALL SELECT vec_id * 3, 'OPEN_CURATED', 2 FROM {embeddings})
    SELECT point_id, trust_level FROM {v_point} WHERE point_id NOT IN (SELECT point_id FROM d)
    UNION ALL SELECT point_id, max_by(trust_level, batch) FROM d GROUP BY point_id
    """,
)
def _(t):
    e = t("embeddings")
    delta = e.select((F.col("vec_id") * 2).alias("point_id"), F.lit("USER_APPROVED").alias("trust_level"), F.lit(1).alias("batch")).unionByName(
        e.select((F.col("vec_id") * 3).alias("point_id"), F.lit("OPEN_CURATED").alias("trust_level"), F.lit(2).alias("batch"))
    )
    return chunks.upsert(t("v_point").select("point_id", "trust_level"), delta)


@query(
    "chunk_delete_filter",
    """
    SELECT 'trust' AS run, point_id FROM {v_point} WHERE trust_level = 'OFFICIAL_BINDING'
    UNION ALL
    SELECT 'subject', point_id FROM {v_point}
    WHERE NOT (subject IS NOT DISTINCT FROM 'RELIGION' AND coalesce(confession_context IN ('EVANGELISCH'), false))
    UNION ALL
    SELECT 'source', point_id FROM {v_point} WHERE source_id <> 7
    """,
)
def _(t):
    p = t("v_point")
    runs = {
        "trust": chunks.delete_where(p, trust_level_not="OFFICIAL_BINDING"),
        "subject": chunks.delete_where(p, subject="RELIGION", confessions=["EVANGELISCH"]),
        "source": chunks.delete_where(p, source_id=7),
    }
    out = None
    for name, left in runs.items():
        part = left.select(F.lit(name).alias("run"), "point_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "chunk_delete_ids",
    """SELECT p.point_id FROM {v_point} p JOIN {v_source} s USING (source_id) WHERE s.lifecycle_status <> 'REVOKED'""",
)
def _(t):
    revoked = t("v_source").filter(F.col("lifecycle_status") == "REVOKED").select("source_id")
    points = t("v_point").select("point_id", "source_id")
    return chunks.delete_ids(points, points.join(revoked, "source_id", "left_semi")).select("point_id")


@query(
    "ingest_commit",
    """
    WITH now AS (SELECT source_id, content_hash, CASE WHEN valid_to IS NOT NULL THEN 'REVOKED' ELSE lifecycle_status END AS st FROM {v_source}),
         staged AS (SELECT source_id, count(*) AS n FROM {v_chunk} GROUP BY source_id)
    SELECT s.source_id, CASE WHEN st = 'APPROVED' AND n IS NOT NULL THEN 'INGESTED' ELSE st END AS lifecycle_status,
           CASE WHEN st = 'APPROVED' AND n IS NOT NULL THEN s.content_hash END AS content_hash,
           CASE WHEN st = 'APPROVED' THEN coalesce(n, 0) ELSE 0 END AS visible,
           CASE WHEN st <> 'APPROVED' THEN coalesce(n, 0) ELSE 0 END AS undone
    FROM now s LEFT JOIN staged g ON g.source_id = s.source_id
    """,
)
def _(t):
    staged = t("v_chunk").select("source_id", F.col("chunk_id").alias("point_id"))
    now = t("v_source").select(
        "source_id",
        F.lit(None).cast("string").alias("content_hash"),
        F.when(F.col("valid_to").isNotNull(), F.lit("REVOKED")).otherwise(F.col("lifecycle_status")).alias("lifecycle_status"),
    )
    visible, updated, undone = chunks.commit(staged, now, t("v_source").select("source_id", "content_hash"))
    seen = visible.groupBy("source_id").agg(F.count("*").alias("visible"))
    back = undone.groupBy(F.substring_index("point_id", ":", 1).cast("bigint").alias("source_id")).agg(F.count("*").alias("undone"))
    zero = F.lit(0).cast("bigint")
    return (
        updated.join(seen, "source_id", "left")
        .join(back, "source_id", "left")
        .select("source_id", "lifecycle_status", "content_hash", F.coalesce("visible", zero).alias("visible"), F.coalesce("undone", zero).alias("undone"))
    )


@query(
    "audit_append",
    """SELECT event_type, actor_id, event_id AS subject,
              CASE WHEN severity <> 'info' THEN '{{"detail":"event ' || cast(event_id AS string) || '"}}' END AS details, severity
       FROM {v_audit}""",
)
def _(t):
    events = t("v_audit").select(
        "event_type",
        "actor_id",
        F.col("event_id").alias("subject"),
        F.when(F.col("severity") != "info", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("detail"),
        "severity",
    )
    return audit.audit_events(events)


GROUNDED_SQL = """
    refs AS (SELECT u.artifact_id, u.position, u.place, u.ref, c.source_id, c.confidence
             FROM (SELECT artifact_id, position, unnest(refs) AS ref, generate_subscripts(refs, 1) AS place FROM {v_statement}) u
             LEFT JOIN {v_citation} c ON c.artifact_id = u.artifact_id AND c.rank = u.ref),
    bad AS (SELECT artifact_id, position, min(CASE WHEN confidence IS NULL THEN place END) AS bad,
                   bool_and(coalesce(confidence = 'GROUNDED', false)) AS ok FROM refs GROUP BY 1, 2),
    cited AS (SELECT r.artifact_id, r.position, r.place, r.source_id FROM refs r JOIN bad b USING (artifact_id, position)
              WHERE b.bad IS NULL OR r.place < b.bad),
    grounded AS (SELECT s.artifact_id, s.position, s.text, s.refs,
                        CASE WHEN coalesce(b.ok, false) THEN 'GROUNDED' ELSE 'UNSUPPORTED_DRAFT' END AS confidence
                 FROM {v_statement} s LEFT JOIN bad b USING (artifact_id, position))
"""


def grounded(t):
    return grounding.ground(t("v_statement"), t("v_citation"))


@query(
    "provenance_rows",
    f"""
    WITH {GROUNDED_SQL}
    SELECT a.artifact_id, SHA256('prompt-' || cast(a.artifact_id AS string)) AS prompt_hash,
           '{{{{"total":' || cast(coalesce(n, 0) AS string) || ',"grounded":' || cast(coalesce(g, 0) AS string)
             || ',"unsupportedDraft":' || cast(coalesce(n - g, 0) AS string) || '}}}}' AS confidence_state,
           coalesce(ids, '') AS source_refs
    FROM (SELECT DISTINCT conv_id AS artifact_id FROM {{conversations}}) a
    LEFT JOIN (SELECT artifact_id, count(*) AS n, count(*) FILTER (confidence = 'GROUNDED') AS g FROM grounded GROUP BY 1) c USING (artifact_id)
    LEFT JOIN (SELECT artifact_id, string_agg(cast(source_id AS string), ',' ORDER BY source_id) AS ids
               FROM (SELECT DISTINCT artifact_id, source_id FROM cited) GROUP BY 1) x USING (artifact_id)
    """,
)
def _(t):
    artifacts = t("conversations").select(F.col("conv_id").alias("artifact_id")).distinct().select(
        "artifact_id",
        F.lit("LESSON").alias("artifact_type"),
        F.concat(F.lit("prompt-"), F.col("artifact_id").cast("string")).alias("prompt"),
        F.lit(False).alias("redaction_applied"),
        (F.col("artifact_id") % 20).alias("owner_id"),
    )
    g = grounded(t)
    rows = audit.provenance(artifacts, grounding.confidence_state(g), grounding.cited_sources(g))
    return rows.select("artifact_id", "prompt_hash", "confidence_state", F.array_join("source_refs", ",").alias("source_refs"))


# ---- predicates ------------------------------------------------------------------


@query(
    "ingest_gate",
    """SELECT source_id, CASE WHEN trust_level = 'UNVERIFIED' THEN 'UNVERIFIED' WHEN lifecycle_status <> 'APPROVED' THEN 'NOT_APPROVED'
                              WHEN NOT license_verified THEN 'LICENSE_NOT_VERIFIED' END AS gate_reason FROM {v_source}""",
)
def _(t):
    return filters.gate(t("v_source")).select("source_id", "gate_reason")


_FOLD_SQL = """
    WITH RECURSIVE c AS (SELECT source_id, seq, command, license_verified AS m,
                      row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n FROM {v_command}),
    r AS (SELECT source_id, cast(0 AS bigint) AS n, cast(-1 AS bigint) AS seq, cast('' AS string) AS command, lifecycle_status AS before,
                 lifecycle_status AS st, license_verified AS v, trust_level AS tr, true AS ok FROM {v_source}
          UNION ALL
          SELECT source_id, n, seq, command, before,
                 CASE WHEN NOT ok THEN before WHEN command = 'register' THEN 'REGISTERED' WHEN command = 'approve' THEN 'APPROVED'
                      WHEN command = 'ingest' THEN 'INGESTED' ELSE 'REVOKED' END,
                 CASE WHEN ok AND command = 'register' THEN coalesce(m, v) ELSE v END, tr, ok
          FROM (SELECT c.source_id, c.n, c.seq, c.command, c.m, r.st AS before, r.v, r.tr,
                       CASE c.command WHEN 'register' THEN r.st IN ('DISCOVERED', 'UNDER_REVIEW')
                            WHEN 'approve' THEN r.st = 'REGISTERED' AND r.v AND r.tr <> 'UNVERIFIED'
                            WHEN 'ingest' THEN r.st = 'APPROVED' ELSE true END AS ok
                FROM r JOIN c ON c.source_id = r.source_id AND c.n = r.n + 1))
"""


@query(
    "lifecycle_apply",
    _FOLD_SQL + """SELECT source_id, max_by(st, n) AS lifecycle_status, max_by(v, n) AS license_verified,
                   count(*) FILTER (NOT ok) AS refused FROM r GROUP BY source_id""",
)
def _(t):
    state, errors = lifecycle.apply_commands(t("v_source"), t("v_command"))
    refused = errors.groupBy("source_id").agg(F.count("*").alias("refused"))
    return state.join(refused, "source_id", "left").select(
        "source_id", "lifecycle_status", "license_verified", F.coalesce("refused", F.lit(0).cast("bigint")).alias("refused")
    )


@query(
    "lifecycle_errors",
    _FOLD_SQL + """SELECT source_id, seq, command, CASE WHEN command = 'approve' AND before = 'REGISTERED' THEN 'APPROVAL_REFUSED'
                   ELSE 'WRONG_STATUS:' || before END AS error FROM r WHERE NOT ok
                   UNION ALL SELECT source_id, seq, command, 'UNKNOWN_SOURCE' FROM {v_command}
                   WHERE source_id NOT IN (SELECT source_id FROM {v_source})""",
)
def _(t):
    return lifecycle.apply_commands(t("v_source"), t("v_command"))[1]


@query(
    "payload_filter",
    """SELECT point_id, trust_level FROM {v_point} WHERE trust_level IS DISTINCT FROM 'UNVERIFIED' AND subject = 'RELIGION'
       AND confession_context IN ('KATHOLISCH', 'KONFESSIONSSENSIBEL_UEBERGREIFEND')""",
)
def _(t):
    return search.payload_filter(
        t("v_point"), "UNVERIFIED", "RELIGION", ["KATHOLISCH", "KONFESSIONSSENSIBEL_UEBERGREIFEND"]
    ).select("point_id", "trust_level")


@query(
    "min_trust",
    "SELECT point_id, trust_level FROM {v_point} WHERE trust_level IN ('OFFICIAL_BINDING', 'OFFICIAL_GUIDANCE', 'OPEN_CURATED')",
)
def _(t):
    return search.min_trust(t("v_point"), "OPEN_CURATED").select("point_id", "trust_level")


@query(
    "confession_check",
    """SELECT source_id, subject, confession_context FROM {v_source} WHERE NOT (subject IS NULL
         OR (subject = 'RELIGION' AND confession_context IN ('EVANGELISCH', 'KATHOLISCH', 'KONFESSIONSSENSIBEL_UEBERGREIFEND'))
         OR (subject = 'ETHIK' AND confession_context IN ('RELIGIONSKUNDLICH', 'NICHT_ANWENDBAR'))
         OR (subject = 'DEUTSCH' AND confession_context = 'NICHT_ANWENDBAR'))""",
)
def _(t):
    return filters.confession_violations(t("v_source")).select("source_id", "subject", "confession_context")


@query(
    "strand_checks",
    """
    SELECT strand_id, 'confession_subject_valid' AS rule FROM {v_strand} WHERE NOT (
      (subject = 'RELIGION' AND confession_context IN ('EVANGELISCH', 'KATHOLISCH', 'KONFESSIONSSENSIBEL_UEBERGREIFEND'))
      OR (subject = 'ETHIK' AND confession_context IN ('RELIGIONSKUNDLICH', 'NICHT_ANWENDBAR'))
      OR (subject = 'DEUTSCH' AND confession_context = 'NICHT_ANWENDBAR'))
    UNION ALL SELECT strand_id, 'form_track_only_sek_i' FROM {v_strand}
      WHERE school_stage <> 'SEK_I' AND (school_form IS NOT NULL OR education_track IS NOT NULL)
    UNION ALL SELECT strand_id, 'track_requires_form' FROM {v_strand} WHERE education_track IS NOT NULL AND school_form IS NULL
    UNION ALL SELECT strand_id, 'valid_to_after_valid_from' FROM {v_strand} WHERE valid_to < valid_from
    """,
)
def _(t):
    return filters.strand_violations(t("v_strand"))


@query(
    "path_classify",
    r"""
    SELECT doc_id, reason IN ('religion-ev', 'deutsch') AS include,
           CASE reason WHEN 'religion-ev' THEN 'RELIGION' WHEN 'deutsch' THEN 'DEUTSCH' END AS subject,
           CASE reason WHEN 'religion-ev' THEN 'EVANGELISCH' WHEN 'deutsch' THEN 'NICHT_ANWENDBAR' END AS confession, reason
    FROM (SELECT doc_id, CASE
        WHEN NOT regexp_matches(p, '[^/]\.(pdf|docx|txt|html|htm|md)$') THEN 'unsupported-type'
        WHEN contains(p, '__pycache__') OR contains(p, '/site-packages/') OR contains(p, '/_report') OR contains(p, 'node_modules')
          OR contains(p, '/.venv') OR contains(p, '/venv/') OR contains(p, '/bin/') OR contains(p, '/lib/python') THEN 'tooling'
        WHEN regexp_matches(p, 'zeugnis|notenübersicht|notenubersicht|\bnoten?\b|klassenarbeit|klausur|pr(?:ü|ue|u)fung|klassenliste|sch[üu]lerliste|diagnos|f[öo]rderplan|gutachten|korrekturhinweise|auswertung|anwesenheit|fehlzeit|datev|freistellung|krankmeld|elternbrief|facharbeit|seminararbeit|bewertung|leseprobe|feedback') THEN 'pii-or-admin'
        WHEN regexp_matches(p, '(^|/)(ka|lk)[ _]') THEN 'student-assessment'
        WHEN regexp_matches(regexp_replace(p, '/[^/]*$', ''), 'biolog|englisch|\bmathe|physik|chemie|\bgeschichte\b|geograf|\bmusik|\bkunst|\bsport|informatik') THEN 'out-of-scope-subject'
        WHEN split_part(p, '/', 1) IN ('3_religion', '3_religion_rag_auswahl') OR contains(p, 'relig') THEN 'religion-ev'
        WHEN regexp_matches(p, '\bethik') THEN 'ethik-deferred' ELSE 'deutsch' END AS reason
      FROM (SELECT doc_id, lower(rel_path) AS p FROM {v_path}))
    """,
)
def _(t):
    return corpus.classify(t("v_path")).select("doc_id", "include", "subject", "confession", "reason")


@query(
    "folder_categorize",
    r"""
    SELECT doc_id, CASE top WHEN 'lehrplaene' THEN CASE WHEN name LIKE 'Lektuereempfehlungen%' OR name LIKE 'Lekt\_reempfehlungen%' ESCAPE '\'
                              OR name = 'Lektuereliste_VOLLTEXT.txt' THEN 'OFFICIAL_GUIDANCE' ELSE 'OFFICIAL_BINDING' END
                   WHEN 'bildungsstandards-kmk' THEN 'OFFICIAL_BINDING' WHEN 'niveaubestimmende-aufgaben' THEN 'OFFICIAL_GUIDANCE'
                   ELSE 'OPEN_CURATED' END AS trust_level,
           CASE WHEN top = 'niveaubestimmende-aufgaben' THEN CASE WHEN sub LIKE 'sek\_kl5%' ESCAPE '\' THEN 'KS5' WHEN sub LIKE 'sek\_kl7%' ESCAPE '\' THEN 'KS7'
             WHEN sub LIKE 'sek\_kl9%' ESCAPE '\' OR sub = 'sek_2012' THEN 'KS9' END END AS grade_band,
           CASE WHEN lower(name) LIKE '%.pdf' THEN 'application/pdf' ELSE 'text/plain' END AS content_type
    FROM (SELECT doc_id, split_part(rel_path, '/', 1) AS top, split_part(rel_path, '/', 2) AS sub, split_part(rel_path, '/', -1) AS name FROM {v_path})
    WHERE top IN ('lehrplaene', 'bildungsstandards-kmk', 'niveaubestimmende-aufgaben', 'lektueren-gemeinfrei')
      AND regexp_matches(lower(name), '(?s).\.(pdf|txt)$')
    """,
)
def _(t):
    return corpus.categorize(t("v_path")).select("doc_id", "trust_level", "grade_band", "content_type")


@query(
    "subject_map",
    """
    SELECT source_id, display, CASE display WHEN 'deutsch' THEN '' WHEN 'ethik' THEN 'RELIGIONSKUNDLICH'
             WHEN 'katholische-religion' THEN 'KATHOLISCH,KONFESSIONSSENSIBEL_UEBERGREIFEND'
             ELSE 'EVANGELISCH,KONFESSIONSSENSIBEL_UEBERGREIFEND' END AS contexts,
           CASE display WHEN 'deutsch' THEN 'DEUTSCH' WHEN 'ethik' THEN 'ETHIK' ELSE 'RELIGION' END AS stored
    FROM (SELECT source_id, CASE WHEN subject = 'DEUTSCH' THEN 'deutsch' WHEN subject = 'ETHIK' THEN 'ethik'
            WHEN confession_context = 'KATHOLISCH' THEN 'katholische-religion' ELSE 'evangelische-religion' END AS display
          FROM {v_source} WHERE subject IS NOT NULL)
    """,
)
def _(t):
    known = t("v_source").filter(F.col("subject").isNotNull())
    shown = known.select("source_id", gov.display_subject("subject", "confession_context").alias("display"))
    return shown.select(
        "source_id",
        "display",
        F.array_join(gov.search_contexts("display"), ",").alias("contexts"),
        gov.stored_subject("display").alias("stored"),
    )


@query("residual_pii_guard", f"SELECT doc_id, {GUARD_CASE} AS pattern FROM {{v_personal}}")
def _(t):
    return t("v_personal").select("doc_id", residual_pattern("text").alias("pattern"))


@query(
    "validity_filter",
    f"""SELECT source_id FROM {{v_source}} WHERE coalesce(valid_from, TIMESTAMP '{AS_OF}') <= TIMESTAMP '{AS_OF}'
        AND coalesce(valid_to, TIMESTAMP '{AS_OF}') >= TIMESTAMP '{AS_OF}' AND lifecycle_status <> 'REVOKED'""",
)
def _(t):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return filters.valid_at(t("v_source"), as_of).select("source_id")


@query(
    "citation_complete",
    """
    SELECT p.point_id, CASE WHEN coalesce(p.chunk_text, '') = '' THEN 'chunk_text' WHEN p.trust_level IS NULL THEN 'trust_level'
             WHEN coalesce(p.content_hash, s.content_hash, '') = '' THEN 'content_hash' WHEN trim(s.title) = '' THEN 'title'
             WHEN trim(coalesce(s.publisher, '')) = '' THEN 'publisher' WHEN trim(coalesce(s.license_info, '')) = '' THEN 'license' END AS reason
    FROM {v_point} p JOIN {v_source} s USING (source_id)
    """,
)
def _(t):
    points = t("v_point").select("point_id", "source_id", "chunk_text", "trust_level", "content_hash", "page_or_section")
    return search.citation_complete(search.with_source(points, t("v_source"))).select("point_id", "reason")


@query(
    "confidence_of",
    """SELECT point_id, CASE WHEN trust_level IN ('OFFICIAL_BINDING', 'OFFICIAL_GUIDANCE') THEN 'GROUNDED' ELSE 'UNSUPPORTED_DRAFT' END AS confidence
       FROM {v_point}""",
)
def _(t):
    return t("v_point").select("point_id", gov.confidence_of("trust_level").alias("confidence"))


@query(
    "request_validate",
    """
    SELECT request_id, CASE WHEN subject IN ('evangelische-religion', 'katholische-religion') AND coalesce(confession, '') = '' THEN 'CONFESSION_REQUIRED'
             WHEN subject = 'ethik' AND coalesce(confession, '') NOT IN ('', 'ethik') THEN 'CONFESSION_NOT_ALLOWED' END AS planning,
           CASE WHEN trim(coalesce(instructions, '')) = '' THEN 'EMPTY_TEXT'
             WHEN subject IN ('evangelische-religion', 'katholische-religion') AND coalesce(confession, '') = '' THEN 'CONFESSION_REQUIRED' END AS correction
    FROM {v_request}
    """,
)
def _(t):
    planning = filters.validate_requests(t("v_request")).withColumnRenamed("blocked_reason", "planning")
    both = filters.validate_requests(planning, text="instructions").withColumnRenamed("blocked_reason", "correction")
    return both.select("request_id", "planning", "correction")


@query(
    "tenant_scope",
    """SELECT unit_id, owner_id FROM {v_unit} WHERE owner_id IN (SELECT DISTINCT owner_id FROM {v_draft} WHERE status = 'DRAFT')""",
)
def _(t):
    entitled = t("v_draft").filter(F.col("status") == "DRAFT")
    return filters.tenant_scope(t("v_unit"), entitled, "owner_id").select("unit_id", "owner_id")


@query(
    "role_check",
    """SELECT c_custkey AS user_id FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def _(t):
    users = t("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("ADMIN")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("TEACHER"))
        .otherwise(F.lit("GUEST")).alias("role"),
    )
    return filters.has_role(users, "TEACHER").select("user_id")


@query(
    "trust_safe_default",
    """SELECT point_id, coalesce(trust_level, 'UNVERIFIED') AS trust, CASE WHEN s.lifecycle_status = 'REVOKED' THEN 'rejected' ELSE 'active' END AS status
       FROM (SELECT point_id, source_id, trust_level FROM {v_point}) p JOIN (SELECT source_id, lifecycle_status FROM {v_source}) s USING (source_id)""",
)
def _(t):
    points = t("v_point").select("point_id", "source_id", "trust_level")
    return points.join(t("v_source").select("source_id", "lifecycle_status"), "source_id").select(
        "point_id", gov.display_trust("trust_level").alias("trust"), gov.display_status("lifecycle_status").alias("status")
    )


@query(
    "table_constraints",
    """
    SELECT 'chunk_text_min_len' AS rule, chunk_id AS violating_key, cast(1 AS bigint) AS n FROM {v_piece} WHERE length(chunk_text) < 50
    UNION ALL SELECT 'chunk_unique', cast(source_id AS string) || '|' || SHA256(chunk_text) || '|' || cast(source_version AS string), count(*)
      FROM {v_piece} GROUP BY source_id, SHA256(chunk_text), source_version HAVING count(*) > 1
    UNION ALL SELECT 'link_unique', cast(l_orderkey AS string) || '|' || cast(l_suppkey AS string), count(*)
      FROM {lineitem} GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1
    UNION ALL SELECT 'node_code_per_strand', cast(strand_id AS string) || '|' || code, count(*)
      FROM (SELECT strand_id, substr(code, 1, 3) AS code FROM {v_strand_node}) GROUP BY strand_id, code HAVING count(*) > 1
    UNION ALL SELECT 'profile_user_unique', cast(o_custkey AS string), count(*) FROM {orders} GROUP BY o_custkey HAVING count(*) > 1
    UNION ALL SELECT 'task_source_ref_unique', cast(l_orderkey AS string) || '|' || cast(l_linenumber AS string) || '|' || cast(l_suppkey AS string), count(*)
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_suppkey HAVING count(*) > 1
    UNION ALL SELECT 'lesson_curriculum_node_unique', cast(l_suppkey AS string) || '|' || cast(l_partkey AS string), count(*)
      FROM {lineitem} GROUP BY l_suppkey, l_partkey HAVING count(*) > 1
    """,
)
def _(t):
    rows = t("v_piece").withColumn("content_hash", F.sha2("chunk_text", 256))
    return filters.constraint_violations(
        [
            filters.short_chunk_violations(rows),
            filters.unique_violations(rows, ["source_id", "content_hash", "source_version"], "chunk_unique"),
            filters.unique_violations(t("lineitem"), ["l_orderkey", "l_suppkey"], "link_unique"),
            # codes of three digits, so that some occur twice
            filters.unique_violations(t("v_strand_node").withColumn("code", F.substring("code", 1, 3)), ["strand_id", "code"], "node_code_per_strand"),
            filters.unique_violations(t("orders"), ["o_custkey"], "profile_user_unique"),
            filters.unique_violations(t("lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey"], "task_source_ref_unique"),
            filters.unique_violations(t("lineitem"), ["l_suppkey", "l_partkey"], "lesson_curriculum_node_unique"),
        ]
    )


_TEXTS_SQL = """CASE WHEN command = 'register' AND seq % 3 <> 0 THEN 'L-' || cast(seq AS string) END AS license_info,
                CASE WHEN command IN ('register', 'approve') AND seq % 2 = 0 THEN command || '-' || cast(seq AS string) END AS approval_metadata"""


@query(
    "lifecycle_metadata",
    f"""
    WITH RECURSIVE c AS (SELECT source_id, seq, command, license_verified AS m, {_TEXTS_SQL},
                      row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n FROM {{v_command}}),
    r AS (SELECT source_id, cast(0 AS bigint) AS n, lifecycle_status AS st, license_verified AS v, trust_level AS tr,
                 license_info AS li, approval_metadata AS am FROM {{v_source}}
          UNION ALL
          SELECT source_id, n, CASE WHEN NOT ok THEN st WHEN command = 'register' THEN 'REGISTERED' WHEN command = 'approve' THEN 'APPROVED'
                                    WHEN command = 'ingest' THEN 'INGESTED' ELSE 'REVOKED' END,
                 CASE WHEN ok AND command = 'register' THEN coalesce(m, v) ELSE v END, tr,
                 CASE WHEN ok AND command = 'register' THEN coalesce(license_info, li) ELSE li END,
                 CASE WHEN ok AND command IN ('register', 'approve') THEN coalesce(approval_metadata, am) ELSE am END
          FROM (SELECT c.*, r.st, r.v, r.tr, r.li, r.am,
                       CASE c.command WHEN 'register' THEN r.st IN ('DISCOVERED', 'UNDER_REVIEW')
                            WHEN 'approve' THEN r.st = 'REGISTERED' AND r.v AND r.tr <> 'UNVERIFIED'
                            WHEN 'ingest' THEN r.st = 'APPROVED' ELSE true END AS ok
                FROM r JOIN c ON c.source_id = r.source_id AND c.n = r.n + 1))
    SELECT source_id, max_by(st, n) AS lifecycle_status, max_by(struct_pack(x := li), n).x AS license_info, max_by(struct_pack(x := am), n).x AS approval_metadata
    FROM r GROUP BY source_id
    """,
)
def _(t):
    commands = t("v_command").selectExpr("*", *_TEXTS_SQL.split(",\n"))
    state, _ = lifecycle.apply_commands(t("v_source"), commands)
    return state.select("source_id", "lifecycle_status", "license_info", "approval_metadata")


@query(
    "correction_provenance",
    """
    SELECT a.artifact_id, SHA256('prompt-' || cast(a.artifact_id AS string)) AS prompt_hash, true AS redaction_applied,
           '{{"rubricCriteria":' || cast(coalesce(k, 0) AS string) || ',"feedbackStatements":' || cast(coalesce(n, 0) AS string)
             || ',"lowConfidence":' || cast(coalesce(low, 0) AS string) || '}}' AS confidence_state, coalesce(ids, '') AS source_refs
    FROM (SELECT DISTINCT conv_id AS artifact_id FROM {conversations}) a
    LEFT JOIN (SELECT artifact_id, count(*) AS n, count(*) FILTER (len(refs) = 0) AS low FROM {v_statement} GROUP BY 1) s USING (artifact_id)
    LEFT JOIN (SELECT conv_id AS artifact_id, count(*) AS k FROM {conversations} WHERE role = 'user' GROUP BY 1) c USING (artifact_id)
    LEFT JOIN (SELECT artifact_id, string_agg(cast(source_id AS string), ',' ORDER BY source_id) AS ids
               FROM (SELECT DISTINCT artifact_id, source_id FROM {v_citation}) GROUP BY 1) x USING (artifact_id)
    """,
)
def _(t):
    drafts = t("conversations").select(F.col("conv_id").alias("artifact_id")).distinct().select(
        "artifact_id", F.concat(F.lit("prompt-"), F.col("artifact_id").cast("string")).alias("prompt"), F.lit("teacher").alias("owner_id")
    )
    level = F.when(F.size("refs") == 0, F.lit("LOW")).otherwise(F.lit("MEDIUM")).alias("confidence_level")
    scores = t("conversations").filter(F.col("role") == "user").select(F.col("conv_id").alias("artifact_id"))
    rows = audit.correction_provenance(drafts, t("v_statement").select("artifact_id", level), scores, t("v_citation"))
    return rows.select("artifact_id", "prompt_hash", "redaction_applied", "confidence_state", F.array_join("source_refs", ",").alias("source_refs"))

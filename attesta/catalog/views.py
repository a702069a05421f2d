"""The given tables in the shape of governed collections.

Each view is one expression over the given tables and grows with them. AS_OF is
the fixed reporting time of the event tables, ORDERS_AS_OF that of the orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.core import Tables, view
from attesta.functions.text import chunk_text
from attesta.operators import search
from attesta.plans.retrieve import PAYLOAD
from attesta.session import staged

AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-07-30 00:00:00"

view(
    "v_source",
    """
    SELECT doc_id AS source_id,
           'doc-' || cast(doc_id AS string) AS title,
           CASE doc_id % 4 WHEN 0 THEN 'https://example.org/' || cast(doc_id AS string) || '.HTML'
                           WHEN 1 THEN 'https://example.org/' || cast(doc_id AS string) || '.txt?v=1'
                           WHEN 2 THEN 'https://example.org/' || cast(doc_id AS string) || '.md'
                           ELSE CASE WHEN doc_id % 12 = 3 THEN 'https://example.org/' || cast(doc_id AS string) || '.pdf'
                                     ELSE 'https://example.org/' || cast(doc_id AS string) || '.txt' END END AS uri,
           CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS publisher,
           CASE WHEN doc_id % 13 = 0 THEN ' ' WHEN doc_id % 37 = 0 THEN '—' ELSE 'CC-BY-4.0' END AS license_info,
           doc_id % 7 <> 0 AS license_verified,
           CASE doc_id % 5 WHEN 0 THEN 'OFFICIAL_BINDING' WHEN 1 THEN 'OFFICIAL_GUIDANCE' WHEN 2 THEN 'OPEN_CURATED'
                           WHEN 3 THEN 'USER_APPROVED' ELSE 'UNVERIFIED' END AS trust_level,
           CASE doc_id % 11 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'UNDER_REVIEW' WHEN 2 THEN 'REGISTERED'
                            WHEN 3 THEN 'REVOKED' ELSE 'APPROVED' END AS lifecycle_status,
           CASE lang WHEN 'en' THEN 'DEUTSCH' WHEN 'de' THEN 'RELIGION' WHEN 'fr' THEN 'ETHIK' END AS subject,
           CASE lang WHEN 'en' THEN CASE WHEN doc_id % 41 = 0 THEN 'EVANGELISCH' ELSE 'NICHT_ANWENDBAR' END
                     WHEN 'de' THEN CASE doc_id % 3 WHEN 0 THEN 'EVANGELISCH' WHEN 1 THEN 'KATHOLISCH'
                                                    ELSE 'KONFESSIONSSENSIBEL_UEBERGREIFEND' END
                     WHEN 'fr' THEN CASE WHEN doc_id % 43 = 0 THEN NULL ELSE 'RELIGIONSKUNDLICH' END
                     END AS confession_context,
           1 AS source_version,
           TIMESTAMP '2024-01-10 08:00:00' AS retrieved_at,
           CASE WHEN doc_id % 29 = 0 THEN NULL ELSE TIMESTAMP '2023-01-01 00:00:00' END AS valid_from,
           CASE WHEN doc_id % 19 = 0 THEN TIMESTAMP '2023-12-31 00:00:00' END AS valid_to,
           CASE WHEN doc_id % 23 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2023-12-01 00:00:00'
                                               ELSE TIMESTAMP '2024-01-25 00:00:00' END END AS deleted_at,
           CASE WHEN doc_id % 11 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2023-11-01 00:00:00'
                                               ELSE TIMESTAMP '2024-01-20 00:00:00' END END AS revoked_at,
           CASE WHEN doc_id % 3 = 0 THEN '{{"ingestKey":"key-' || cast(doc_id AS string) || '"}}' END AS approval_metadata,
           CASE doc_id % 6 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'SENSITIVE_STUDENT'
                           WHEN 3 THEN 'SENSITIVE_STUDENT_RELIGION' WHEN 4 THEN 'PERSONAL_TEACHER'
                           ELSE 'INTERNAL_USER_UPLOAD' END AS data_class,
           SHA256(text) AS content_hash,
           text AS content
    FROM {documents}
    """,
)


# one phrase for each pattern of personal data, planted by document
PERSONAL = [
    "Kennung SN-12345.", "ID: 123456.", "Matrikelnummer: 12345678.", "Mail an anna@schule.example.de.", "Telefon 0391 555 66 77 88.",
    "Tel +43 (1) 555 667788.", "am 01.02.2010.", "am 2010-02-01.", "am 01/02/2010.", "geboren am 1.2.2010.", "in 39104 Magdeburg.",
    "Lindenstraße 5.", "wohnhaft in Halle an der Saale.", "hat LRS.", "ist katholisch.", "ein Asylantrag.", "Schülerin: Anna Muster.",
    "Vorname: Max, dann [SCHÜLER_PSEUDONYM] Meier.",
]
view(  # whole texts; two in three carry a phrase at the end
    "v_personal",
    f"""
    SELECT doc_id, text || CASE doc_id % {len(PERSONAL) * 3 // 2} {" ".join(f"WHEN {i} THEN ' {p}'" for i, p in enumerate(PERSONAL))} ELSE '' END AS text
    FROM {{documents}}
    """,
)


def _pieces(t: Tables):
    rows = chunk_text(t("v_source"), keep=["source_id", "source_version", "lifecycle_status"])
    return rows.withColumn("chunk_id", F.concat_ws(":", F.col("source_id").cast("string"), F.col("chunk_index").cast("string")))


view(  # chunks of all sources, whatever their status
    "v_piece",
    """
    SELECT source_id, source_version, lifecycle_status, i AS chunk_index, substring(content, i * 800 + 1, 1000) AS chunk_text,
           'chunk:' || cast(i AS string) AS page_or_section,
           cast(source_id AS string) || ':' || cast(i AS string) AS chunk_id
    FROM (SELECT *, unnest(range(0, 1 + cast(ceil(greatest(length(content) - 1000, 0) / 800.0) AS int)))::int AS i
          FROM {v_source} WHERE trim(content) <> '')
    """,
    _pieces,
)

view(  # chunks in the index: those of approved sources
    "v_chunk",
    """
    SELECT source_id, source_version, chunk_index, chunk_text, page_or_section, chunk_id
    FROM {v_piece} WHERE lifecycle_status = 'APPROVED'
    """,
)

view(
    "v_point",
    """
    SELECT e.vec_id AS point_id, e.embedding AS vector, e.label, s.source_id,
           CASE WHEN e.vec_id % 29 = 0 THEN NULL ELSE s.trust_level END AS trust_level,
           s.subject, s.confession_context,
           CASE WHEN e.vec_id % 31 = 0 THEN NULL ELSE s.content END AS chunk_text,
           'chunk:' || cast(e.vec_id AS string) AS page_or_section,
           CASE WHEN e.vec_id % 37 = 0 THEN NULL ELSE s.content_hash END AS content_hash
    FROM (SELECT *, vec_id * 7919 % (SELECT max(doc_id) + 1 FROM {documents}) AS doc_id FROM {embeddings}) e
    JOIN {v_source} s ON s.source_id = e.doc_id
    """,
)


def _queries(t: Tables):
    parts = t("embeddings").select(
        "label", (F.col("vec_id") % 4).alias("v"), F.posexplode("embedding").alias("pos", "x")
    )
    means = parts.groupBy("label", "v", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy("label", "v").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector")
    )
    queries = packed.select(
        (F.col("label") * 4 + F.col("v")).cast("bigint").alias("query_id"),
        "label",
        "vector",
        F.when(F.col("v") == 1, F.lit("deutsch"))
        .when(F.col("v") == 2, F.lit("evangelische-religion"))
        .when(F.col("v") == 3, F.lit("ethik"))
        .alias("display_subject"),
    )
    return staged(queries)  # one row per label and variant, from a pass over all vectors


view(  # one query per label and variant: the mean of their vectors, over all vectors
    "v_query",
    """
    SELECT cast(label * 4 + v AS bigint) AS query_id, label, list(x ORDER BY pos) AS vector,
           CASE v WHEN 1 THEN 'deutsch' WHEN 2 THEN 'evangelische-religion' WHEN 3 THEN 'ethik' END AS display_subject
    FROM (SELECT label, v, pos, avg(x) AS x
          FROM (SELECT label, vec_id % 4 AS v, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos
                FROM {embeddings}) GROUP BY label, v, pos)
    GROUP BY label, v
    """,
    _queries,
)

def _hits(t: Tables):
    # at most 15 rows per query; several reports start from them
    return staged(search.search_payload(search.query_filters(t("v_query")), t("v_point"), PAYLOAD, limit=15))


def _wide_hits(t: Tables):
    return staged(search.search_payload(search.query_filters(t("v_query")), t("v_point"), PAYLOAD, limit=30))


view(  # exact scores, the filter clauses of the display subject, best 30 per query
    "v_hit_wide",
    """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (
        SELECT q.query_id, p.*, list_cosine_similarity(q.vector, p.vector::double[]) AS score
        FROM {v_query} q JOIN {v_point} p
          ON p.trust_level IS DISTINCT FROM 'UNVERIFIED'
         AND CASE q.display_subject WHEN 'deutsch' THEN p.subject = 'DEUTSCH'
               WHEN 'evangelische-religion' THEN p.subject = 'RELIGION'
                 AND p.confession_context IN ('EVANGELISCH', 'KONFESSIONSSENSIBEL_UEBERGREIFEND')
               WHEN 'ethik' THEN p.subject = 'ETHIK' AND p.confession_context = 'RELIGIONSKUNDLICH'
               ELSE true END))
    WHERE rank <= 30
    """,
    _wide_hits,
)

view("v_hit", "SELECT * FROM {v_hit_wide} WHERE rank <= 15", _hits)


def _questions(t: Tables):
    expected = (
        t("v_point")
        .filter(F.col("trust_level").isin("OFFICIAL_BINDING", "OFFICIAL_GUIDANCE"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_set("source_id")).alias("expected_source_ids"))
    )
    questions = t("v_query").join(expected, "label").select(
        F.col("query_id").alias("question_id"),
        F.when(F.col("label") % 2 == 0, F.lit("DEUTSCH")).otherwise(F.lit("RELIGION")).alias("domain"),
        F.when(F.col("query_id") % 7 == 0, F.lit("blocked-source-not-approved")).otherwise(F.lit("active")).alias("status"),
        "expected_source_ids",
        "vector",
        "display_subject",
    )
    return staged(questions)


view(
    "v_question",
    """
    SELECT q.query_id AS question_id, CASE WHEN q.label % 2 = 0 THEN 'DEUTSCH' ELSE 'RELIGION' END AS domain,
           CASE WHEN q.query_id % 7 = 0 THEN 'blocked-source-not-approved' ELSE 'active' END AS status,
           x.expected_source_ids, q.vector, q.display_subject
    FROM {v_query} q JOIN (SELECT label, list(DISTINCT source_id ORDER BY source_id) AS expected_source_ids FROM {v_point}
                           WHERE trust_level IN ('OFFICIAL_BINDING', 'OFFICIAL_GUIDANCE') GROUP BY label) x
      ON x.label = q.label
    """,
    _questions,
)

view(
    "v_audit",
    """
    SELECT event_id, ts, user_id AS actor_id, user_id % 10 AS school_id, upper(event_type) || '_EVENT' AS event_type,
           CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
           CASE WHEN event_id % 3 = 0 THEN '{{"detail":"event ' || cast(event_id AS string) || '"}}' ELSE props END AS details,
           value AS latency
    FROM {events}
    """,
)

view(
    "v_strand",
    """
    SELECT s_suppkey AS strand_id, cast(s_nationkey AS bigint) AS tenant_id,
           CASE s_suppkey % 3 WHEN 0 THEN 'DEUTSCH' WHEN 1 THEN 'RELIGION' ELSE 'ETHIK' END AS subject,
           CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 12 = 9 THEN 'KATHOLISCH' ELSE 'NICHT_ANWENDBAR' END
                              WHEN 1 THEN CASE s_suppkey % 4 WHEN 0 THEN 'EVANGELISCH' WHEN 1 THEN 'KATHOLISCH'
                                               ELSE 'KONFESSIONSSENSIBEL_UEBERGREIFEND' END
                              ELSE 'RELIGIONSKUNDLICH' END AS confession_context,
           CASE s_nationkey % 3 WHEN 0 THEN 'GESAMTSCHULE' WHEN 1 THEN 'GEMEINSCHAFTSSCHULE' END AS school_form,
           CASE s_suppkey % 5 WHEN 0 THEN 'GYMNASIALER_BILDUNGSGANG' WHEN 1 THEN 'REALSCHULBILDUNGSGANG' END AS education_track,
           CASE WHEN s_suppkey % 7 = 3 THEN 'SEK_II' ELSE 'SEK_I' END AS school_stage,
           CASE WHEN s_suppkey % 6 = 5 THEN 'RETIRED' ELSE 'ACTIVE' END AS status,
           s_name AS authority, 'v' || cast(s_suppkey % 4 AS string) AS version,
           TIMESTAMP '2023-01-01 00:00:00' AS valid_from,
           CASE WHEN s_suppkey % 8 = 1 THEN TIMESTAMP '2022-06-01 00:00:00' END AS valid_to,
           CASE WHEN s_suppkey >= 4 AND s_suppkey % 4 < 3 THEN s_suppkey - 4 END AS supersedes_id
    FROM {supplier}
    """,
)

view(
    "v_unit",
    """
    SELECT c_custkey AS unit_id, cast(c_nationkey AS bigint) AS strand_id, c_custkey % 50 AS owner_id, c_name AS title,
           'KS' || cast(5 + c_custkey % 6 AS string) AS grade_band,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'ARCHIVED' WHEN 'MACHINERY' THEN 'DRAFT' ELSE 'ACTIVE' END AS status,
           TIMESTAMP '2001-01-01 00:00:00' AS created_at,
           CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '2001-07-31 00:00:00' ELSE TIMESTAMP '2000-01-01 00:00:00' END AS updated_at,
           CASE WHEN c_custkey % 16 = 15 THEN TIMESTAMP '2001-02-01 00:00:00' END AS deleted_at
    FROM {customer}
    """,
)

view(
    "v_sheet",
    """
    SELECT o_orderkey AS sheet_id, o_custkey AS unit_id, o_custkey % 50 AS owner_id,
           'sheet-' || cast(o_orderkey AS string) AS title, o_orderdate AS created_at, o_orderdate AS updated_at,
           CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2001-07-01 00:00:00' END AS deleted_at
    FROM {orders}
    """,
)

view(
    "v_task",
    """
    SELECT l_orderkey * 10 + l_linenumber AS task_id, l_orderkey AS sheet_id, min(l_partkey) AS node_id
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber
    """,
)

view("v_link", "SELECT DISTINCT l_orderkey AS sheet_id, l_suppkey AS source_id FROM {lineitem}")

view(
    "v_supplied",
    """
    SELECT s_suppkey AS source_id,
           CASE WHEN s_suppkey % 4 = 0 THEN 'RELIGION' END AS subject,
           CASE WHEN s_suppkey % 8 = 0 THEN 'KATHOLISCH' WHEN s_suppkey % 4 = 0 THEN 'EVANGELISCH' END AS confession_context
    FROM {supplier}
    """,
)

view(
    "v_submission",
    """
    SELECT conv_id * 100 + turn AS submission_id, (conv_id * 10 + turn) AS task_id, 'P' || cast(conv_id AS string) AS pseudonym,
           text AS work
    FROM {conversations} WHERE role = 'user'
    """,
)

view(
    "v_draft",
    """
    SELECT conv_id * 100 + turn AS draft_id, conv_id * 100 + turn - 1 AS submission_id, conv_id % 20 AS owner_id,
           CASE conv_id % 3 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'HUMAN_CONFIRMED' ELSE 'OVERRIDDEN' END AS status,
           conv_id * 7 % 31 AS created_at,
           CASE WHEN conv_id % 10 = 9 THEN TIMESTAMP '2001-07-01 00:00:00' END AS deleted_at
    FROM {conversations} WHERE role = 'assistant'
    """,
)

view(
    "v_statement",
    """
    SELECT conv_id AS artifact_id, turn AS position, text,
           CASE WHEN turn % 5 = 3 THEN EMPTY_INTS
                ELSE LIST(cast(turn AS int), cast(conv_id % 8 AS int)) END AS refs
    FROM {conversations} WHERE role = 'assistant'
    """,
)

view(  # every turn offers one citation, ranked without gaps
    "v_citation",
    """
    SELECT c.conv_id AS artifact_id, cast(c.turn + 1 AS int) AS rank, s.source_id, s.title, s.trust_level,
           CASE WHEN s.trust_level IN ('OFFICIAL_BINDING', 'OFFICIAL_GUIDANCE') THEN 'GROUNDED' ELSE 'UNSUPPORTED_DRAFT' END AS confidence
    FROM (SELECT conv_id, turn, (conv_id * 7919 + turn * 5) % (SELECT max(doc_id) + 1 FROM {documents}) AS doc_id FROM {conversations}) c
    JOIN {v_source} s ON s.source_id = c.doc_id
    """,
)

view(
    "v_grant",
    """
    SELECT s_suppkey AS grant_id, cast(s_nationkey AS bigint) AS school_id, 'provider-' || cast(s_suppkey % 2 AS string) AS provider,
           CASE WHEN s_suppkey % 4 = 0 THEN EMPTY_STRINGS ELSE LIST('deutsch', 'ethik') END AS scope_subjects,
           CASE WHEN s_suppkey % 3 = 0 THEN LIST('KS5', 'KS6', 'KS7') ELSE EMPTY_STRINGS END AS scope_grade_bands,
           TIMESTAMP '2024-01-01 00:00:00' AS valid_from,
           CASE WHEN s_suppkey % 5 = 4 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2024-01-31 00:00:00' END AS valid_until
    FROM {supplier}
    """,
)

view(
    "v_request",
    """
    SELECT c_custkey AS request_id, cast(CASE WHEN c_custkey % 21 = 20 THEN NULL ELSE c_nationkey END AS bigint) AS school_id,
           c_custkey % 50 AS user_id,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'local' ELSE 'cloud' END AS provider_kind,
           'provider-' || cast(c_custkey % 2 AS string) AS provider,
           CASE c_custkey % 4 WHEN 0 THEN 'deutsch' WHEN 1 THEN 'evangelische-religion' WHEN 2 THEN 'katholische-religion'
                              ELSE 'ethik' END AS subject,
           CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'evangelische-religion' END AS confession,
           CASE c_custkey % 3 WHEN 0 THEN ' Gesamtschule' WHEN 1 THEN 'gemeinschaftsschule' ELSE 'gymnasium' END AS school_form,
           'KS' || cast(5 + c_custkey % 6 AS string) AS grade_band,
           c_name AS topic,
           CASE WHEN c_custkey % 6 = 0 THEN '["45 Minuten", " LRS ", "45 Minuten", ""]' WHEN c_custkey % 6 = 1 THEN 'a; b;;a ;c'
                WHEN c_custkey % 6 = 2 THEN '{{"x":1}}' WHEN c_custkey % 6 = 3 THEN '' ELSE NULL END AS constraints_raw,
           CASE WHEN c_custkey % 7 = 0 THEN ' kurz ' END AS instructions
    FROM {customer}
    """,
)

view(  # file paths made of the source, language and content of the documents; folders and types vary by key
    "v_path",
    """
    SELECT doc_id,
           CASE doc_id % 10 WHEN 0 THEN '2_Deutsch' WHEN 1 THEN '3_Religion' WHEN 2 THEN 'lehrplaene' WHEN 3 THEN 'lektueren-gemeinfrei'
                WHEN 4 THEN 'niveaubestimmende-aufgaben' WHEN 5 THEN 'bildungsstandards-kmk' WHEN 6 THEN 'Materialsammlung-RAG'
                WHEN 7 THEN 'Ethik' WHEN 8 THEN 'Privat' ELSE 'tools' END
           || '/' ||
           CASE doc_id % 7 WHEN 0 THEN 'Biologie' WHEN 1 THEN 'sek_kl5_aufgaben' WHEN 2 THEN 'sek_2012' WHEN 3 THEN 'bin'
                WHEN 4 THEN 'Klassenarbeiten' WHEN 5 THEN 'sek_kl9' ELSE 'Allgemein' END
           || '/' ||
           CASE doc_id % 11 WHEN 0 THEN 'KA_' WHEN 1 THEN 'Lektuereempfehlungen_' WHEN 2 THEN 'Noten-' WHEN 3 THEN 'Religion_' ELSE '' END
           || source || '_' || lang || '-' || SHA256(text)
           || CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.docx' WHEN 3 THEN '.png' WHEN 4 THEN '.md'
                WHEN 5 THEN '' ELSE '.txt' END AS rel_path
    FROM {documents}
    """,
)

view(
    "v_registry",
    """
    SELECT 'src-' || cast(doc_id AS string) AS entry_id, 'title ' || cast(doc_id AS string) AS title,
           source AS publisher, 'https://example.org/' || cast(doc_id AS string) AS official_url, 'frei' AS license_or_terms,
           CASE doc_id % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'Official' ELSE 'unverified' END AS trust_level,
           CASE doc_id % 5 WHEN 0 THEN 'framework' WHEN 1 THEN 'Curriculum' WHEN 2 THEN 'guidance' WHEN 3 THEN 'legal' ELSE 'law' END AS source_type,
           CASE doc_id % 7 WHEN 0 THEN 'DEUTSCH' WHEN 1 THEN 'ethik' WHEN 2 THEN 'RELIGION_EV' WHEN 3 THEN 'RELIGION_KATH'
                           WHEN 4 THEN 'RELIGION_KA' WHEN 5 THEN 'RELIGION' ELSE 'ALLGEMEIN' END AS subject
    FROM {documents}
    """,
)

view(  # entries that an earlier run imported
    "v_imported",
    """
    SELECT '{{"sourceSeedId":"src-' || cast(doc_id AS string) || '"}}' AS approval_metadata
    FROM {labels} WHERE quality = 1
    """,
)

view(
    "v_node",
    """
    SELECT p_partkey AS node_id, CASE WHEN p_partkey = 0 THEN NULL ELSE cast((p_partkey - p_partkey % 10) / 10 AS bigint) END AS parent_id,
           cast(0 AS bigint) AS strand_id, cast(p_partkey AS string) AS code, p_name AS title, p_type AS competence_area,
           CASE WHEN p_size % 3 = 0 THEN p_brand END AS description, 'KS' || cast(5 + p_size % 6 AS string) AS grade_band
    FROM {part}
    """,
)

view(  # the same nodes spread over strands
    "v_strand_node",
    """
    SELECT p_partkey AS node_id, p_partkey % 10 AS strand_id, cast(p_partkey AS string) AS code, p_name AS title,
           CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS competence_area, CASE WHEN p_size % 3 = 0 THEN p_brand END AS description,
           CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'KS' || cast(5 + p_size % 6 AS string) END AS grade_band,
           CASE WHEN p_partkey < 20 THEN NULL ELSE p_partkey - 10 - p_partkey % 2 END AS parent_id
    FROM {part}
    """,
)

view(
    "v_version",
    """
    SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey - 1 END AS supersedes_id,
           CASE WHEN p_size % 4 = 0 THEN 'ACTIVE' ELSE 'RETIRED' END AS status
    FROM {part}
    """,
)

view(
    "v_command",
    """
    SELECT user_id AS source_id, event_id AS seq,
           CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'ingest'
                           WHEN 'view' THEN 'register' ELSE CASE WHEN value > 200 THEN 'revoke' ELSE 'approve' END END AS command,
           CASE WHEN event_type = 'signup' THEN user_id % 3 <> 0 END AS license_verified
    FROM {events}
    """,
)

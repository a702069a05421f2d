"""Registered queries: aggregates, rankings and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.core import query
from attesta.catalog.dialect import redaction_ctes
from attesta.catalog.q_sources import GROUNDED_SQL, grounded
from attesta.catalog.views import AS_OF, ORDERS_AS_OF
from attesta.operators import aggregates, evaluate, grounding, ranking
from attesta.plans.ingest import ingest_batch
from attesta.rules import REDACTION
from attesta.sources import corpus


@query(
    "index_quality",
    """
    WITH c AS (SELECT count(*) AS chunks, count(DISTINCT source_id) AS indexed FROM {v_chunk}),
         s AS (SELECT count(*) AS total, count(*) FILTER (coalesce(license_info, '') NOT IN ('', '—')) AS licensed FROM {v_source} WHERE deleted_at IS NULL)
    SELECT chunks, indexed AS indexed_sources, total, cast(floor(licensed * 100.0 / total + 0.5) AS bigint) AS metadata_coverage,
           cast(floor(indexed * 100.0 / total + 0.5) AS bigint) AS indexed_share, greatest(0, total - indexed) AS needing_review,
           CASE WHEN chunks > 0 THEN 'aktuell' ELSE 'leer' END AS freshness FROM c, s
    """,
)
def _(t):
    return aggregates.index_quality(t("v_source").filter(F.col("deleted_at").isNull()), t("v_chunk"))


@query(
    "governance_counts",
    """
    SELECT * FROM (
      SELECT 'gov-unverified' AS check_id, count(*) FILTER (trust_level = 'UNVERIFIED') AS n FROM {v_source} WHERE deleted_at IS NULL
      UNION ALL SELECT 'gov-registered', count(*) FILTER (lifecycle_status = 'REGISTERED') FROM {v_source} WHERE deleted_at IS NULL
      UNION ALL SELECT 'gov-approved', count(*) FILTER (lifecycle_status = 'APPROVED') FROM {v_source} WHERE deleted_at IS NULL)
    WHERE check_id = 'gov-unverified' OR n > 0
    """,
)
def _(t):
    return aggregates.governance_counts(t("v_source"))


@query(
    "dashboard_metrics",
    f"""
    SELECT owner_id, sum(u)::bigint AS units, sum(s)::bigint AS sheets, sum(d)::bigint AS drafts,
           (SELECT count(*) FROM {{v_source}} WHERE deleted_at IS NULL) AS sources
    FROM (SELECT owner_id, 1 AS u, 0 AS s, 0 AS d FROM {{v_unit}} WHERE deleted_at IS NULL AND status <> 'ARCHIVED'
          UNION ALL SELECT owner_id, 0, 1, 0 FROM {{v_sheet}} WHERE deleted_at IS NULL AND created_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY
          UNION ALL SELECT owner_id, 0, 0, 1 FROM {{v_draft}} WHERE deleted_at IS NULL AND status = 'DRAFT')
    GROUP BY owner_id
    """,
)
def _(t):
    return aggregates.dashboard_metrics(t("v_unit"), t("v_sheet"), t("v_draft"), t("v_source"), ORDERS_AS_OF)


RANKED_SQL = "SELECT query_id AS question_id, rank, source_id FROM {v_hit}"

SCORES_SQL = f"""
    hit AS (SELECT r.question_id, r.rank FROM ({RANKED_SQL}) r JOIN {{v_question}} q USING (question_id)
            WHERE list_contains(q.expected_source_ids, r.source_id)),
    agg AS (SELECT question_id, count(*) FILTER (rank <= 5) AS p, count(*) FILTER (rank <= 10) AS r, min(rank) AS f FROM hit GROUP BY 1),
    scores AS (SELECT q.question_id, q.domain, coalesce(p / 5.0::double, 0.0) AS precision_at_5,
                      coalesce(r::double / len(q.expected_source_ids), 0.0) AS recall_at_10, coalesce(1.0::double / f, 0.0) AS reciprocal_rank
               FROM {{v_question}} q LEFT JOIN agg USING (question_id) WHERE q.status = 'active')
"""


def ranked(t):
    return t("v_hit").select(F.col("query_id").alias("question_id"), "rank", "source_id")


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "retrieval_metrics",
    f"""WITH {SCORES_SQL} SELECT question_id, domain, round(precision_at_5, 6) AS precision_at_5, round(recall_at_10, 6) AS recall_at_10,
        round(reciprocal_rank, 6) AS reciprocal_rank FROM scores""",
)
def _(t):
    return _rounded(evaluate.score_questions(ranked(t), t("v_question")), "precision_at_5", "recall_at_10", "reciprocal_rank")


_SUMMARY_SQL = """
    summary AS (SELECT domain, count(*) AS questions, avg(precision_at_5) AS mean_precision_at_5, avg(recall_at_10) AS mean_recall_at_10,
                       avg(reciprocal_rank) AS mean_reciprocal_rank, CAST(NULL AS bigint) AS total, CAST(NULL AS bigint) AS skipped FROM scores GROUP BY domain
                UNION ALL
                SELECT NULL, count(*), coalesce(avg(precision_at_5), 0), coalesce(avg(recall_at_10), 0), coalesce(avg(reciprocal_rank), 0),
                       (SELECT count(*) FROM {v_question}), (SELECT count(*) FROM {v_question} WHERE status <> 'active') FROM scores)
"""


@query(
    "eval_summary",
    f"""WITH {SCORES_SQL}, {_SUMMARY_SQL} SELECT domain, questions, round(mean_precision_at_5, 6) AS mean_precision_at_5,
        round(mean_recall_at_10, 6) AS mean_recall_at_10, round(mean_reciprocal_rank, 6) AS mean_reciprocal_rank, total, skipped FROM summary""",
)
def _(t):
    summary = evaluate.summarize(evaluate.score_questions(ranked(t), t("v_question")), t("v_question"))
    return _rounded(summary, "mean_precision_at_5", "mean_recall_at_10", "mean_reciprocal_rank")


@query(
    "metric_drift",
    f"""
    WITH {SCORES_SQL}, {_SUMMARY_SQL},
         u AS (SELECT domain, 'mean_precision_at_5' AS metric, mean_precision_at_5 AS value FROM summary
               UNION ALL SELECT domain, 'mean_recall_at_10', mean_recall_at_10 FROM summary
               UNION ALL SELECT domain, 'mean_reciprocal_rank', mean_reciprocal_rank FROM summary),
         b AS (SELECT domain, metric, value + CASE metric WHEN 'mean_precision_at_5' THEN 0.06 WHEN 'mean_recall_at_10' THEN 0.05 ELSE 0.2 END AS value
               FROM u WHERE domain IS DISTINCT FROM 'RELIGION' OR metric <> 'mean_reciprocal_rank')
    SELECT u.domain, u.metric, round(b.value, 6) AS baseline, round(u.value, 6) AS current, round(u.value - b.value, 6) AS delta
    FROM u JOIN b ON u.domain IS NOT DISTINCT FROM b.domain AND u.metric = b.metric WHERE b.value - u.value > 0.05 + 1e-9
    """,
)
def _(t):
    summary = evaluate.summarize(evaluate.score_questions(ranked(t), t("v_question")), t("v_question"))
    current = evaluate.unpivot_means(summary)
    shift = F.when(F.col("metric") == "mean_precision_at_5", F.lit(0.06)).when(F.col("metric") == "mean_recall_at_10", F.lit(0.05)).otherwise(F.lit(0.2))
    known = ~F.col("domain").eqNullSafe(F.lit("RELIGION")) | (F.col("metric") != "mean_reciprocal_rank")
    baseline = current.filter(known).withColumn("value", F.col("value") + shift)
    return _rounded(evaluate.drift(current, baseline), "baseline", "current", "delta")


@query(
    "ndcg_at_k",
    f"""
    WITH {SCORES_SQL},
    g AS (SELECT question_id, sum(1.0::double / log2(rank + 1)) AS dcg FROM hit WHERE rank <= 5 GROUP BY 1)
    SELECT q.question_id, round(coalesce(dcg / (SELECT sum(1.0::double / log2(i + 1)) FROM range(1, 6) AS x(i) WHERE i <= len(q.expected_source_ids)), 0), 6) AS ndcg
    FROM {{v_question}} q LEFT JOIN g USING (question_id) WHERE status = 'active'
    """,
)
def _(t):
    return _rounded(evaluate.ndcg(ranked(t), t("v_question")), "ndcg")


@query(
    "expected_overlap",
    f"WITH {SCORES_SQL} SELECT question_id, count(*) AS relevant, min(rank) AS first_rank FROM hit GROUP BY question_id",
)
def _(t):
    hits = evaluate.relevant_hits(ranked(t), t("v_question"))
    return hits.groupBy("question_id").agg(F.count("*").alias("relevant"), F.min("rank").cast("bigint").alias("first_rank"))


@query(
    "confidence_counts",
    f"""WITH {GROUNDED_SQL} SELECT artifact_id, count(*) AS total, count(*) FILTER (confidence = 'GROUNDED') AS grounded,
        count(*) FILTER (confidence <> 'GROUNDED') AS unsupported FROM grounded GROUP BY artifact_id""",
)
def _(t):
    return grounding.confidence_state(grounded(t))


@query(
    "cited_sources",
    f"""WITH {GROUNDED_SQL} SELECT artifact_id, string_agg(cast(source_id AS string), ',' ORDER BY source_id) AS source_ids
        FROM (SELECT DISTINCT artifact_id, source_id FROM cited) GROUP BY artifact_id""",
)
def _(t):
    return grounding.cited_sources(grounded(t)).select("artifact_id", F.array_join("source_ids", ",").alias("source_ids"))


@query(
    "grounding_rates",
    f"""
    WITH {GROUNDED_SQL},
    st AS (SELECT g.artifact_id, g.confidence, len(g.refs) AS r, (SELECT count(*) FROM cited c WHERE c.artifact_id = g.artifact_id AND c.position = g.position) AS c FROM grounded g),
    a AS (SELECT artifact_id, max(c) AS mc FROM st GROUP BY 1)
    SELECT (SELECT count(*) FROM a) AS artifacts, round((SELECT avg(CASE WHEN mc > 0 THEN 1.0 ELSE 0.0 END) FROM a), 6) AS coverage,
           round(count(*) FILTER (confidence <> 'GROUNDED') / count(*), 6) AS unsupported_rate, round(sum(c)::double / sum(r), 6) AS resolved_rate FROM st
    """,
)
def _(t):
    return _rounded(grounding.grounding_rates(grounded(t)), "coverage", "unsupported_rate", "resolved_rate")


@query(
    "exclusion_counts",
    r"""
    SELECT reason, reason IN ('religion-ev', 'deutsch') AS include, count(*) AS files FROM (SELECT CASE
        WHEN NOT regexp_matches(p, '[^/]\.(pdf|docx|txt|html|htm|md)$') THEN 'unsupported-type'
        WHEN contains(p, '/bin/') OR contains(p, '__pycache__') OR contains(p, 'node_modules') THEN 'tooling'
        WHEN regexp_matches(p, 'zeugnis|\bnoten?\b|klassenarbeit|klausur|pr(?:ü|ue|u)fung|diagnos|f[öo]rderplan|bewertung|feedback') THEN 'pii-or-admin'
        WHEN regexp_matches(p, '(^|/)(ka|lk)[ _]') THEN 'student-assessment'
        WHEN regexp_matches(regexp_replace(p, '/[^/]*$', ''), 'biolog|englisch|\bmathe|physik|\bgeschichte\b|\bmusik|\bkunst|\bsport') THEN 'out-of-scope-subject'
        WHEN split_part(p, '/', 1) = '3_religion' OR contains(p, 'relig') THEN 'religion-ev'
        WHEN regexp_matches(p, '\bethik') THEN 'ethik-deferred' ELSE 'deutsch' END AS reason FROM (SELECT lower(rel_path) AS p FROM {v_path}))
    GROUP BY reason
    """,
)
def _(t):
    return aggregates.exclusion_summary(corpus.classify(t("v_path")))


INGEST_SQL = f"""
    pages_text AS (SELECT s.*, CASE WHEN trust_level = 'UNVERIFIED' THEN 'UNVERIFIED' WHEN lifecycle_status <> 'APPROVED' THEN 'NOT_APPROVED'
                                 WHEN NOT license_verified THEN 'LICENSE_NOT_VERIFIED' END AS gate,
                        CASE WHEN lower(uri) LIKE '%.html' THEN
                          trim(regexp_replace(replace(replace(replace(replace(replace(replace(
                            regexp_replace(regexp_replace(regexp_replace(content, '(?i)<script[^>]*>[\\s\\S]*?</script>', ' ', 'g'), '(?i)<style[^>]*>[\\s\\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
                            '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#039;', ''''), '\\s{{{{2,}}}}', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13))
                          WHEN lower(uri) LIKE '%.txt%' OR lower(uri) LIKE '%.md' THEN content END AS extracted
                   FROM {{v_source}} s WHERE deleted_at IS NULL),
    judged0 AS (SELECT *, CASE WHEN trim(coalesce(extracted, ''), ' ' || chr(10) || chr(9) || chr(13)) = '' THEN 'EXTRACTION_FAILED' WHEN length(extracted) < 50 THEN 'NO_USABLE_CHUNKS' END AS failure FROM pages_text),
    holder AS (SELECT content_hash, min(source_id) AS held_by FROM judged0 WHERE gate IS NULL AND failure IS NULL GROUP BY 1),
    judged AS (SELECT j.*, CASE WHEN gate IS NOT NULL THEN gate WHEN held_by < source_id THEN 'DUPLICATE_CONTENT' ELSE failure END AS reason
               FROM judged0 j LEFT JOIN holder USING (content_hash)),
    pieces AS (SELECT source_id, trust_level, i, substring(extracted, i * 800 + 1, 1000) AS chunk_text
               FROM (SELECT *, unnest(range(0, 1 + cast(ceil(greatest(length(extracted) - 1000, 0) / 800.0) AS int)))::int AS i FROM judged WHERE reason IS NULL)),
    kept AS (SELECT source_id, trust_level, i, chunk_text FROM pieces WHERE length(chunk_text) >= 50
             QUALIFY row_number() OVER (PARTITION BY source_id, SHA256(chunk_text) ORDER BY i) = 1),
    outcome AS (SELECT j.source_id, CASE WHEN reason IS NULL THEN 'ingested' WHEN reason = 'DUPLICATE_CONTENT' THEN 'skipped' ELSE 'failed' END AS outcome,
                       reason, coalesce(n, 0) AS chunks FROM judged j LEFT JOIN (SELECT source_id, count(*) AS n FROM kept GROUP BY 1) USING (source_id))
"""


@query(
    "ingest_summary",
    f"WITH {INGEST_SQL} SELECT outcome, reason, count(*) AS sources, cast(sum(chunks) AS bigint) AS chunks FROM outcome GROUP BY outcome, reason",
)
def _(t):
    return ingest_batch(t("v_source")).report


@query(
    "ingest_batch",
    f"WITH {INGEST_SQL} SELECT source_id, cast(i AS int) AS chunk_index, SHA256(chunk_text) AS content_hash, trust_level FROM kept",
)
def _(t):
    return ingest_batch(t("v_source")).chunks.select("source_id", "chunk_index", "content_hash", "trust_level")


@query(
    "redaction_stats",
    f"""WITH {redaction_ctes('{v_personal}', 'doc_id')},
    masks AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{m}')" for c, m, _ in REDACTION)}) AS v(category, mask)),
    found AS (SELECT x, unnest(string_split(rtrim(hit, ','), ',')) AS category FROM m6 WHERE hit <> '')
    SELECT category, count(*) AS texts, sum((length(x) - length(replace(x, mask, ''))) // length(mask))::bigint AS masks
    FROM found JOIN masks USING (category) GROUP BY category""",
)
def _(t):
    return aggregates.redaction_stats(t("v_personal"))


@query(
    "available_subjects",
    """
    SELECT display_subject, CASE display_subject WHEN 'deutsch' THEN 0 WHEN 'evangelische-religion' THEN 1 WHEN 'katholische-religion' THEN 2 ELSE 3 END AS position,
           CASE display_subject WHEN 'deutsch' THEN 'Deutsch' WHEN 'evangelische-religion' THEN 'Ev. Religion' WHEN 'katholische-religion' THEN 'Kath. Religion' ELSE 'Ethik' END AS label
    FROM (SELECT DISTINCT CASE WHEN subject = 'DEUTSCH' THEN 'deutsch' WHEN subject = 'ETHIK' THEN 'ethik'
            WHEN confession_context = 'KATHOLISCH' THEN 'katholische-religion' ELSE 'evangelische-religion' END AS display_subject
          FROM {v_strand} WHERE status = 'ACTIVE')
    """,
)
def _(t):
    return aggregates.available_subjects(t("v_strand"))


@query(
    "feedback_text",
    """SELECT artifact_id AS draft_id, SHA256(string_agg(text, chr(10) || chr(10) ORDER BY position)) AS text_hash,
              length(string_agg(text, chr(10) || chr(10) ORDER BY position)) AS characters FROM {v_statement} GROUP BY artifact_id""",
)
def _(t):
    joined = aggregates.feedback_text(t("v_statement").withColumnRenamed("artifact_id", "draft_id"))
    return joined.select("draft_id", F.sha2("feedback_text", 256).alias("text_hash"), F.length("feedback_text").cast("bigint").alias("characters"))


@query(
    "feedback_counts",
    """SELECT draft_id, len(string_split(text, '. ')) AS rubric_criteria, len(string_split(text, chr(10))) AS feedback_statements,
              (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS s) WHERE length(s) % 3 = 0) AS low_confidence
       FROM (SELECT conv_id * 100 + turn AS draft_id, text FROM {conversations} WHERE role = 'assistant')""",
)
def _(t):
    drafts = t("conversations").filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("draft_id"),
        F.split("text", r"\. ").alias("rubric_scores"),
        F.transform(
            F.split("text", "\n"),
            lambda s: F.struct(s.alias("text"), F.when(F.length(s) % 3 == 0, F.lit("LOW")).otherwise(F.lit("HIGH")).alias("level")),
        ).alias("statements"),
    )
    return aggregates.feedback_counts(drafts)


@query(
    "source_footer",
    """
    SELECT source_id AS artifact_id, 'Quellen:' || chr(10) || '1. ' || title || ', ' || uri || CASE WHEN license_info <> '' THEN ' (' || license_info || ')' ELSE '' END
           || chr(10) || '2. ' || data_class || coalesce(' (' || subject || ')', '')
           || coalesce(chr(10) || 'Adaptiert von: ' || publisher, '') || coalesce(chr(10) || 'Lizenz: ' || confession_context, '') AS footer
    FROM {v_source}
    """,
)
def _(t):
    none = F.lit(None).cast("string")
    artifacts = t("v_source").select(
        F.col("source_id").alias("artifact_id"),
        F.array(
            F.struct(F.col("title"), F.col("uri").alias("locator"), F.col("license_info").alias("license")),
            F.struct(F.col("data_class").alias("title"), none.alias("locator"), F.col("subject").alias("license")),
        ).alias("sources"),
        F.col("publisher").alias("derivation_source"),
        F.col("confession_context").alias("license"),
    )
    return aggregates.source_footer(artifacts)


@query(
    "duplicate_hash_report",
    """SELECT content_hash, source_id, copies FROM (SELECT content_hash, source_id, count(*) OVER (PARTITION BY content_hash) AS copies FROM {v_source})
       WHERE copies > 1""",
)
def _(t):
    return aggregates.duplicate_hash_report(t("v_source"))


@query(
    "latency_report",
    """SELECT event_type, count(*) AS events, round(quantile_cont(latency, 0.95), 6) AS p95, round(count(*) FILTER (severity = 'critical') / count(*), 6) AS error_rate,
              quantile_cont(latency, 0.95) > 150 AS latency_alert, count(*) FILTER (severity = 'critical') / count(*) > 0.01 AS error_alert
       FROM {v_audit} GROUP BY event_type""",
)
def _(t):
    report = aggregates.latency_report(t("v_audit"), ["event_type"], is_error=F.col("severity") == "critical", target=150.0)
    return _rounded(report, "p95", "error_rate")


@query(
    "phase_quartiles",
    """
    SELECT artifact_id, position, least(4 * (row_number() OVER w - 1) // count(*) OVER (PARTITION BY artifact_id), 3) AS phase_index
    FROM {v_statement} WINDOW w AS (PARTITION BY artifact_id ORDER BY position)
    """,
)
def _(t):
    return ranking.phase_quartiles(t("v_statement")).select("artifact_id", "position", F.col("phase_index").cast("bigint").alias("phase_index"))


@query(
    "first_chunk_wins",
    """SELECT source_id, chunk_index, SHA256(chunk_text) AS content_hash FROM {v_piece} WHERE length(chunk_text) >= 50
       QUALIFY row_number() OVER (PARTITION BY source_id, SHA256(chunk_text) ORDER BY chunk_index) = 1""",
)
def _(t):
    return ranking.first_chunk_wins(t("v_piece")).select("source_id", "chunk_index", "content_hash")


@query(
    "activity_feed",
    f"""
    SELECT school_id, rank, event_id, upper(substring(tt, 1, 1)) || substring(tt, 2) AS title,
           CASE WHEN event_id % 3 = 0 THEN 'event ' || cast(event_id AS string) ELSE 'Ereignis: ' || upper(substring(tt, 1, 1)) || substring(tt, 2) END AS detail,
           CASE WHEN severity = 'info' THEN 'info' ELSE 'warn' END AS icon,
           CASE WHEN m < 1 THEN 'gerade eben' WHEN m < 60 THEN 'vor ' || cast(m AS string) || ' Min.' WHEN m < 1440 THEN 'vor ' || cast(m // 60 AS string) || ' Std.'
                WHEN m // 1440 = 1 THEN 'gestern' WHEN m // 1440 < 7 THEN 'vor ' || cast(m // 1440 AS string) || ' Tagen' ELSE strftime(ts, '%-d.%-m.%Y') END AS modified
    FROM (SELECT *, lower(replace(event_type, '_', ' ')) AS tt, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) // 60000000 AS m,
                 row_number() OVER (PARTITION BY school_id ORDER BY ts DESC, event_id) AS rank FROM {{v_audit}}) WHERE rank <= 6
    """,
)
def _(t):
    return ranking.activity_feed(t("v_audit"), AS_OF).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "quick_access",
    """
    SELECT tenant_id, rank, strand_id, 'Lehrplan ' || CASE WHEN subject = 'DEUTSCH' THEN 'Deutsch' WHEN subject = 'ETHIK' THEN 'Ethik'
             WHEN confession_context = 'KATHOLISCH' THEN 'Kath. Religion' ELSE 'Ev. Religion' END AS title,
           CASE WHEN education_track = 'GYMNASIALER_BILDUNGSGANG' THEN 'Gymnasialer Bildungsgang' WHEN school_form = 'GESAMTSCHULE' THEN 'Gesamtschule'
                ELSE 'Gemeinschaftsschule' END || ' · ' || CASE WHEN school_stage = 'SEK_II' THEN 'Sek II' ELSE 'Klassen 5–10' END AS subtitle,
           CASE WHEN subject = 'DEUTSCH' THEN 'primary' ELSE 'green' END AS accent
    FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY strand_id) AS rank FROM {v_strand} WHERE status = 'ACTIVE') WHERE rank <= 3
    """,
)
def _(t):
    return ranking.quick_access(t("v_strand")).withColumn("rank", F.col("rank").cast("bigint"))

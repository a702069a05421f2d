"""Registered queries: retention, streaming and end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.core import Tables, query

from attesta.catalog.q_relations import _mmr_rounds
from attesta.catalog.q_reports import INGEST_SQL
from attesta.catalog.q_sources import _FOLD_SQL, GROUNDED_SQL

from attesta.catalog.views import AS_OF, ORDERS_AS_OF
from attesta.functions import text
from attesta.operators import retention
from attesta.plans import jobs
from attesta.plans.ingest import ingest_and_commit
from attesta.plans.gateway import PromptTexts
from attesta.plans.retrieve import retrieve_batch
from attesta.session import stage_folder
from attesta.sources.index import ChunkIndex
from attesta.streaming import jobs as streams

# ---- retention ---------------------------------------------------------------------


@query(
    "soft_delete",
    f"""
    SELECT 'table' AS part, sheet_id, deleted_at IS NOT NULL OR sheet_id IN (SELECT l_orderkey FROM {{lineitem}} WHERE l_returnflag = 'R') AS deleted,
           CAST(NULL AS string) AS details FROM {{v_sheet}}
    UNION ALL SELECT 'audit', sheet_id, true, l_suppkey || ' {{{{"worksheetId":"' || cast(sheet_id AS string) || '"}}}}'
      FROM {{lineitem}} JOIN {{v_sheet}} ON sheet_id = l_orderkey WHERE l_returnflag = 'R'
    UNION ALL SELECT DISTINCT 'unknown', l_orderkey, false, NULL FROM {{lineitem}} WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT sheet_id FROM {{v_sheet}})
    """,
)
def _(t):
    asked = t("lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("sheet_id"), F.col("l_suppkey").alias("actor_id"))
    table, audit, unknown = retention.soft_delete(t("v_sheet"), asked, ORDERS_AS_OF)
    none = F.lit(None).cast("string")
    return (
        table.select(F.lit("table").alias("part"), "sheet_id", F.col("deleted_at").isNotNull().alias("deleted"), none.alias("details"))
        .unionByName(
            audit.select(
                F.lit("audit").alias("part"),
                F.get_json_object("details", "$.worksheetId").cast("bigint").alias("sheet_id"),
                F.lit(True).alias("deleted"),
                F.concat_ws(" ", "actor_id", "details").alias("details"),
            )
        )
        .unionByName(unknown.select(F.lit("unknown").alias("part"), "sheet_id", F.lit(False).alias("deleted"), none.alias("details")))
    )


@query(
    "revoke_source",
    """
    WITH r AS (SELECT DISTINCT user_id AS source_id FROM {events} WHERE event_type = 'error' AND value > 150)
    SELECT 'table' AS part, source_id, CASE WHEN source_id IN (SELECT source_id FROM r) THEN 'REVOKED' ELSE lifecycle_status END AS note FROM {v_source}
    UNION ALL SELECT 'revoked_at', source_id, cast(CASE WHEN source_id IN (SELECT source_id FROM r) THEN coalesce(revoked_at, TIMESTAMP 'AS_OF')
        ELSE revoked_at END AS DATE)::string FROM {v_source}
    UNION ALL SELECT 'audit', user_id, event_id || ' warning' FROM {events} WHERE event_type = 'error' AND value > 150
        AND user_id IN (SELECT source_id FROM {v_source})
    UNION ALL SELECT 'unknown', source_id, NULL FROM r WHERE source_id NOT IN (SELECT source_id FROM {v_source})
    """.replace("AS_OF", AS_OF),
)
def _(t):
    asked = t("events").filter((F.col("event_type") == "error") & (F.col("value") > 150)).select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("actor_id")
    )
    table, audit, unknown = retention.revoke_sources(t("v_source"), asked, AS_OF)
    return (
        table.select(F.lit("table").alias("part"), "source_id", F.col("lifecycle_status").alias("note"))
        .unionByName(table.select(F.lit("revoked_at").alias("part"), "source_id", F.col("revoked_at").cast("date").cast("string").alias("note")))
        .unionByName(
            audit.select(
                F.lit("audit").alias("part"),
                F.get_json_object("details", "$.sourceRefId").cast("bigint").alias("source_id"),
                F.concat_ws(" ", "actor_id", "severity").alias("note"),
            )
        )
        .unionByName(unknown.select(F.lit("unknown").alias("part"), "source_id", F.lit(None).cast("string").alias("note")))
    )


@query(
    "retention_due",
    f"""
    SELECT doc AS source_id, data_class FROM (SELECT o_orderkey AS doc, o_orderdate, CASE o_orderkey % 6 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'SENSITIVE_STUDENT'
             WHEN 3 THEN 'SENSITIVE_STUDENT_RELIGION' WHEN 4 THEN 'PERSONAL_TEACHER' ELSE 'INTERNAL_USER_UPLOAD' END AS data_class FROM {{orders}})
    WHERE cast(o_orderdate AS date) + CASE data_class WHEN 'INTERNAL' THEN INTERVAL 84 MONTH WHEN 'SENSITIVE_STUDENT' THEN INTERVAL 24 MONTH
            WHEN 'SENSITIVE_STUDENT_RELIGION' THEN INTERVAL 12 MONTH WHEN 'PERSONAL_TEACHER' THEN INTERVAL 12 MONTH WHEN 'INTERNAL_USER_UPLOAD' THEN INTERVAL 36 MONTH END
          < DATE '{ORDERS_AS_OF[:10]}'
    """,
)
def _(t):
    k = F.col("o_orderkey") % 6
    names = ["PUBLIC", "INTERNAL", "SENSITIVE_STUDENT", "SENSITIVE_STUDENT_RELIGION", "PERSONAL_TEACHER", "INTERNAL_USER_UPLOAD"]
    rows = t("orders").select(
        F.col("o_orderkey").alias("source_id"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int")).alias("data_class"),
        F.col("o_orderdate").alias("retained_from"),
    )
    return retention.retention_due(rows, ORDERS_AS_OF).select("source_id", "data_class")


_DUE_SQL = f"""SELECT source_id FROM {{v_source}} WHERE (deleted_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY OR revoked_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)
               AND source_id NOT IN (SELECT doc_id FROM {{labels}} WHERE toxic = 1)"""


def _holds(t):
    return t("labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("source_id"))


@query("hard_delete_due", _DUE_SQL)
def _(t):
    return retention.hard_delete_due(t("v_source"), _holds(t), AS_OF).select("source_id")


_EXPIRED_SQL = """
    SELECT c_custkey AS student_id, CASE WHEN asked THEN 'REQUEST' ELSE 'EXPIRED' END AS reason FROM (
      SELECT c.c_custkey, c.c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') AS asked, l.left_on
      FROM {customer} c LEFT JOIN (SELECT o_custkey, cast(max(o_orderdate) AS date) AS left_on FROM {orders} GROUP BY 1) l ON l.o_custkey = c.c_custkey)
    WHERE asked OR left_on + INTERVAL 12 MONTH < DATE 'AT'
"""


def _pseudonyms(t):
    """(mappings with the last day of activity, requests to forget)."""
    last = t("orders").groupBy(F.col("o_custkey").alias("student_id")).agg(F.max("o_orderdate").cast("date").alias("left_on"))
    mappings = t("customer").select(F.col("c_custkey").alias("student_id")).join(last, "student_id", "left")
    return mappings, t("orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("student_id"))


@query("pseudonym_expiry", _EXPIRED_SQL.replace("AT'", ORDERS_AS_OF[:10] + "'"))
def _(t):
    return retention.pseudonym_expiry(*_pseudonyms(t), ORDERS_AS_OF).select("student_id", "reason")


_PURGE_SQL = f"""
    old AS (SELECT source_id, 'RETENTION' AS reason FROM {{v_source}}
                 WHERE source_id NOT IN (SELECT doc_id FROM {{labels}} WHERE toxic = 1)
                   AND cast(valid_from AS date) + CASE data_class WHEN 'INTERNAL' THEN INTERVAL 84 MONTH WHEN 'SENSITIVE_STUDENT' THEN INTERVAL 24 MONTH
                     WHEN 'SENSITIVE_STUDENT_RELIGION' THEN INTERVAL 12 MONTH WHEN 'PERSONAL_TEACHER' THEN INTERVAL 12 MONTH
                     WHEN 'INTERNAL_USER_UPLOAD' THEN INTERVAL 36 MONTH END < DATE '{AS_OF[:10]}'),
    due AS (SELECT source_id, min(reason) AS reason FROM (SELECT * FROM old UNION ALL SELECT source_id, 'GRACE_OVER' FROM ({_DUE_SQL})) GROUP BY source_id)"""


@query(
    "purge",
    f"""
    WITH {_PURGE_SQL},
    gone AS ({_EXPIRED_SQL.replace("AT'", AS_OF[:10] + "'")})
    SELECT 'source' AS part, cast(source_id AS string) AS row_id FROM {{v_source}} WHERE source_id NOT IN (SELECT source_id FROM due)
    UNION ALL SELECT 'chunk', chunk_id FROM {{v_chunk}} WHERE source_id NOT IN (SELECT source_id FROM due)
    UNION ALL SELECT 'plan', chunk_id FROM {{v_chunk}} WHERE source_id IN (SELECT source_id FROM due)
    UNION ALL SELECT 'plan', cast(sheet_id AS string) || '|' || cast(source_id AS string) FROM {{v_link}} WHERE source_id IN (SELECT source_id FROM due)
    UNION ALL SELECT 'mapping', cast(c_custkey AS string) FROM {{customer}} WHERE c_custkey NOT IN (SELECT student_id FROM gone)
    UNION ALL SELECT 'audit', reason || ':' || cast(source_id AS string) FROM due
    UNION ALL SELECT 'audit', reason || ':' || cast(student_id AS string) FROM gone
    """,
)
def _(t):
    mappings, asked = _pseudonyms(t)
    done = jobs.purge(t("v_source"), t("v_chunk"), t("v_link"), _holds(t), mappings, asked, AS_OF, "retention-job", since="valid_from")
    parts = [
        done.sources.select(F.lit("source").alias("part"), F.col("source_id").cast("string").alias("row_id")),
        done.chunks.select(F.lit("chunk").alias("part"), F.col("chunk_id").alias("row_id")),
        done.mappings.select(F.lit("mapping").alias("part"), F.col("student_id").cast("string").alias("row_id")),
        done.plan.select(F.lit("plan").alias("part"), "row_id"),
        done.audit.select(F.lit("audit").alias("part"), F.get_json_object("details", "$.detail").alias("row_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "purge_index",
    f"""
    WITH {INGEST_SQL}, {_PURGE_SQL}
    SELECT part, source_id, cast(i AS int) AS chunk_index FROM kept, (SELECT unnest(['served', 'stored']) AS part)
    WHERE source_id NOT IN (SELECT source_id FROM due)
    UNION ALL SELECT 'plan', source_id, cast(i AS int) FROM kept WHERE source_id IN (SELECT source_id FROM due)
    """,
)
def _(t):
    """Everything ingested, then what is due deleted from the files of the index."""
    index = ChunkIndex(t.spark, _place(t, "index"))
    ingest_and_commit(t("v_source"), index, t("v_source").select("source_id", "content_hash", "lifecycle_status"), 0)
    mappings, asked = _pseudonyms(t)
    chunks = index.served().withColumn("chunk_id", F.col("point_id"))
    done = jobs.purge(t("v_source"), chunks, t("v_link"), _holds(t), mappings, asked, AS_OF, "retention-job", since="valid_from", index=index)
    named = done.plan.filter(F.col("table") == "rag_chunk").select("row_id")
    planned = chunks.select(F.col("chunk_id").alias("row_id"), "source_id", "chunk_index").join(named.hint("shuffle_hash"), "row_id")
    parts = {"served": done.chunks, "stored": index.tables.read("chunks"), "plan": planned}
    out = [rows.select(F.lit(name).alias("part"), "source_id", "chunk_index") for name, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---- streaming ---------------------------------------------------------------------


def _stream(t: Tables, name: str):
    """One given table, a file or a folder of files, as a file stream.

    All its files come in one batch: the SQL twins know no arrival order, and files need not
    be in the order of ids or times.
    """
    live, path = t.spark.readStream.schema(t(name).schema), f"{t.folder}/{name}.parquet"
    if streams.is_folder(t.spark, path):
        return live.parquet(path)
    return live.option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _place(t: Tables, name: str) -> str:
    return f"{stage_folder(t.spark)}/{name}"


def stream_tables(t: Tables, name: str) -> Tables:
    """The views over one streamed table."""
    return Tables(t.spark, t.folder, {name: _stream(t, name)})


_WINDOW_SQL = """
    SELECT window_start, event_type, count(*) AS events, round(count(*) FILTER (severity = 'critical') / count(*), 6) AS error_rate,
           round(quantile_cont(latency, 0.95), 6) AS p95, quantile_cont(latency, 0.95) > 150 AS latency_alert,
           count(*) FILTER (severity = 'critical') / count(*) > 0.01 AS error_alert
    FROM (SELECT *, date_trunc('hour', ts) AS window_start FROM {v_audit}) GROUP BY window_start, event_type
"""

# the stream gives the nearest rank instead of an interpolated value
_RANK_WINDOW_SQL = _WINDOW_SQL.replace("quantile_cont(latency, 0.95)", "list_sort(list(latency))[cast(ceil(0.95 * count(latency)) AS int)]")


def _windows(df):
    return df.withColumn("error_rate", F.round("error_rate", 6)).withColumn("p95", F.round("p95", 6))


@query("audit_windows", _WINDOW_SQL)
def _(t):
    return _windows(streams.audit_windows(t("v_audit"), target=150.0))


@query(
    "stream_audit_windows",
    f"SELECT * FROM ({_RANK_WINDOW_SQL}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM {{events}}) - INTERVAL 10 MINUTE",
)
def _(t):
    base = _place(t, "windows")
    live = stream_tables(t, "events")("v_audit").withColumn("ts", F.col("ts").cast("timestamp"))
    streams.stream_audit_windows(live, f"{base}/out", f"{base}/check", target=150.0).awaitTermination()
    out = _windows(t.spark.read.parquet(f"{base}/out").drop("batch"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_dedup", "SELECT DISTINCT SHA256(props) AS content_hash FROM {events}")
def _(t):
    base = _place(t, "dedup")
    live = _stream(t, "events").select(F.sha2("props", 256).alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"))
    streams.stream_dedup(live, f"{base}/out", f"{base}/check", delay="60 days").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("content_hash")


@query(
    "stream_dedup_exact",
    "SELECT doc_id AS source_id, held_by FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS held_by FROM {documents}) WHERE doc_id <> held_by",
)
def _(t):
    base = _place(t, "dedup-exact")
    live = _stream(t, "documents").select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("content_hash"))
    streams.stream_dedup_exact(live, base, f"{base}/check").awaitTermination()
    return t.spark.read.parquet(f"{base}/duplicates").select("source_id", "held_by")


@query(
    "stream_lifecycle",
    _FOLD_SQL + """SELECT source_id, max_by(st, n) AS lifecycle_status, count(*) FILTER (NOT ok) AS refused FROM r WHERE source_id IN (SELECT source_id FROM c) GROUP BY source_id
        UNION ALL SELECT source_id, NULL, count(*) FROM {v_command} WHERE source_id NOT IN (SELECT source_id FROM {v_source}) GROUP BY source_id""",
)
def _(t):
    base = _place(t, "lifecycle")
    live = stream_tables(t, "events")("v_command")
    streams.stream_lifecycle(live, t("v_source"), base, f"{base}/check").awaitTermination()
    out = t.spark.read.parquet(f"{base}/out")
    return out.groupBy("source_id").agg(
        F.max_by("lifecycle_status", "seq").alias("lifecycle_status"), F.count_if(F.col("error").isNotNull()).alias("refused")
    )


_KEPT_SQL = f"WITH {INGEST_SQL} SELECT source_id, cast(i AS int) AS chunk_index, SHA256(chunk_text) AS content_hash, trust_level FROM kept"


@query("stream_ingest", _KEPT_SQL)
def _(t):
    return _ingested(t, "ingest")


def _ingested(t: Tables, name: str):
    base = _place(t, name)
    live = stream_tables(t, "documents")("v_source")
    streams.stream_ingest(live, base, f"{base}/check").awaitTermination()
    if name == "revocation":
        revoked = _stream(t, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("source_id"))
        streams.stream_revocation(revoked, base, f"{base}/check-revoked").awaitTermination()
    return streams.served_chunks(t.spark, base).select("source_id", "chunk_index", "content_hash", "trust_level")


def _run_sql(n: int, rows: str, held: str | None, late: str) -> str:
    """Common tables of one committed run over ``rows``: verdict{n}, and cur{n} with what each source serves after it."""
    texts = INGEST_SQL[: INGEST_SQL.index("holder AS")].replace("{v_source} s", f"run{n} s")
    texts = texts.replace("pages_text", f"pages{n}").replace("judged0", f"facts{n}")
    before = held or "none"
    return f"""
    run{n} AS ({rows}), {texts}
    holder{n} AS (SELECT content_hash, min(source_id) AS held_by FROM facts{n} WHERE gate IS NULL AND failure IS NULL GROUP BY 1),
    judged{n} AS (
      SELECT f.source_id, f.trust_level, f.content_hash, f.extracted,
             CASE WHEN gate IS NOT NULL THEN gate WHEN own.content_hash = f.content_hash THEN 'UNCHANGED_CONTENT'
                  WHEN coalesce(other.source_id <> f.source_id, held_by < f.source_id) THEN 'DUPLICATE_CONTENT' ELSE failure END AS reason
      FROM facts{n} f LEFT JOIN holder{n} h ON h.content_hash = f.content_hash LEFT JOIN {before} own ON own.source_id = f.source_id
      LEFT JOIN {before} other ON other.content_hash = f.content_hash),
    verdict{n} AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND {late} THEN 'NOT_APPROVED_ANY_MORE' ELSE reason END AS reason) FROM judged{n}),
    cur{n} AS (SELECT source_id, trust_level, content_hash, extracted FROM verdict{n} WHERE reason IS NULL
               UNION ALL SELECT * FROM {before} WHERE source_id NOT IN (SELECT source_id FROM verdict{n} WHERE reason IS NULL)),
    pieces{n} AS (
      SELECT source_id, i, substring(extracted, i * 800 + 1, 1000) AS chunk_text
      FROM (SELECT *, unnest(range(0, 1 + cast(ceil(greatest(length(extracted) - 1000, 0) / 800.0) AS int)))::int AS i FROM cur{n})),
    kept{n} AS (SELECT source_id, i, chunk_text FROM pieces{n} WHERE length(chunk_text) >= 50
                QUALIFY row_number() OVER (PARTITION BY source_id, SHA256(chunk_text) ORDER BY i) = 1),
    size{n} AS (SELECT source_id, count(*) AS chunks FROM kept{n} GROUP BY source_id)"""


_NONE_SQL = "none AS (SELECT source_id, trust_level, content_hash, content AS extracted FROM {v_source} WHERE false)"


def _changed(content: str) -> str:
    return f"SELECT * REPLACE ({content} AS content, SHA256({content}) AS content_hash) FROM {{v_source}}"


def _outcome_sql(n: int, run: str) -> str:
    return f"""SELECT '{run}' AS part, source_id, CASE WHEN reason IS NULL THEN 'ingested'
                      WHEN reason IN ('DUPLICATE_CONTENT', 'UNCHANGED_CONTENT') THEN 'skipped' ELSE 'failed' END AS outcome, reason,
                      CASE WHEN reason IS NULL THEN chunks ELSE 0 END AS chunks
               FROM verdict{n} LEFT JOIN size{n} USING (source_id)"""


_NEW_TEXT = "CASE WHEN source_id % 4 = 0 THEN content || ' neu' ELSE content END"


@query(
    "ingest_and_commit",
    f"""
    WITH {_NONE_SQL}, {_run_sql(0, "SELECT * FROM {v_source} WHERE source_id % 2 = 0", None, "source_id % 18 = 2")},
    {_run_sql(1, _changed(_NEW_TEXT) + " WHERE source_id % 10 <> 9", "cur0", "source_id % 6 = 1")}
    {_outcome_sql(0, "run 0")}
    UNION ALL {_outcome_sql(1, "run 1")}
    UNION ALL SELECT 'run 1', source_id, 'skipped', 'KNOWN_KEY', 0 FROM {{v_source}} WHERE source_id % 10 = 9
    UNION ALL SELECT 'registry', source_id, 'INGESTED', content_hash, 0 FROM verdict1 WHERE reason IS NULL
    UNION ALL SELECT 'served', source_id, NULL, content_hash, chunks FROM cur1 JOIN size1 USING (source_id)
    """,
)
def _(t):
    """Two runs over the same sources: changed, unchanged, repeated and known contents, and revocations before the commit."""
    index = ChunkIndex(t.spark, _place(t, "index"))
    sources = t("v_source").withColumn("ingest_key", F.concat(F.lit("key-"), F.col("source_id").cast("string")))
    changed = sources.withColumn("content", F.expr(_NEW_TEXT))
    known = sources.filter("source_id % 10 = 9").select("ingest_key")

    def registry(late: str):
        status = F.when(F.expr(late), F.lit("REVOKED")).otherwise(F.col("lifecycle_status")).alias("lifecycle_status")
        return t("v_source").select("source_id", F.lit(None).cast("string").alias("content_hash"), status)

    first = ingest_and_commit(sources.filter("source_id % 2 = 0"), index, registry("source_id % 18 = 2"), 0)
    second = ingest_and_commit(changed, index, registry("source_id % 6 = 1"), 1, known_keys=known)
    chunks = index.served().groupBy("source_id").agg(F.count("*").alias("chunks"))
    marked = second.sources.filter(F.col("content_hash").isNotNull())
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")

    def part(name: str, rows, outcome="outcome", reason="reason", chunks="chunks"):
        outcome = F.col(outcome) if isinstance(outcome, str) else outcome
        chunks = F.col(chunks) if isinstance(chunks, str) else chunks
        return rows.select(F.lit(name).alias("part"), "source_id", outcome.alias("outcome"), F.col(reason).alias("reason"), chunks.alias("chunks"))

    return (
        part("run 0", first.outcomes)
        .unionByName(part("run 1", second.outcomes))
        .unionByName(part("registry", marked, "lifecycle_status", "content_hash", zero))
        .unionByName(part("served", index.current(chunks).join(chunks, "source_id"), none, "content_hash"))
    )


_BACK_SQL = """SELECT * FROM {v_source} WHERE source_id % 8 = 0 UNION ALL
               SELECT s.* REPLACE (left_text AS content, SHA256(left_text) AS content_hash)
               FROM {v_source} s JOIN neighbour ON id = source_id WHERE source_id % 2 = 1"""


@query(
    "stream_ingest_returns",
    f"""
    WITH {_NONE_SQL}, {_run_sql(0, "SELECT * FROM {v_source} WHERE source_id % 2 = 0", None, "source_id % 10 = 6")},
    {_run_sql(1, _changed("'neu ' || content") + " WHERE source_id % 4 = 0", "cur0", "source_id % 10 = 6")},
    neighbour AS (SELECT source_id + 1 AS id, content AS left_text FROM {{v_source}}),
    {_run_sql(2, _BACK_SQL, "cur1", "source_id % 10 = 6")}
    SELECT source_id, i AS chunk_index, SHA256(chunk_text) AS content_hash FROM kept2
    """,
)
def _(t):
    """Sources that change and come back over three batches, and others that bring what these have left."""
    base = _place(t, "returns")
    sources = t("v_source")
    text = sources.select((F.col("source_id") + 1).alias("source_id"), F.col("content").alias("_text"))
    neighbours = sources.filter("source_id % 2 = 1").join(text, "source_id").withColumn("content", F.col("_text")).drop("_text")
    batches = [
        sources.filter("source_id % 2 = 0"),
        sources.filter("source_id % 4 = 0").withColumn("content", F.concat(F.lit("neu "), "content")),
        sources.filter("source_id % 8 = 0").unionByName(neighbours),
    ]
    status = F.when(F.col("source_id") % 10 == 6, F.lit("REVOKED")).otherwise(F.col("lifecycle_status")).alias("lifecycle_status")
    for batch in batches:
        batch.write.mode("append").parquet(f"{base}/in")
        live = t.spark.readStream.schema(sources.schema).parquet(f"{base}/in")
        streams.stream_ingest(live, base, f"{base}/check", registry=lambda: sources.select("source_id", status)).awaitTermination()
    return streams.served_chunks(t.spark, base).select("source_id", "chunk_index", "content_hash")


@query("stream_revocation", _KEPT_SQL + " WHERE source_id NOT IN (SELECT doc_id FROM {labels} WHERE toxic = 1)")
def _(t):
    return _ingested(t, "revocation")


# ---- jobs --------------------------------------------------------------------------


def _retrieved_sql(k: int, floor: str) -> str:
    return f"""
    h AS MATERIALIZED (SELECT * FROM {{v_hit_wide}} WHERE rank <= {3 * k} AND {floor}), {_mmr_rounds('h', k)},
    got AS (SELECT p.query_id, p.mmr_rank, p.point_id, p.score, h.source_id, h.trust_level, s.title
            FROM p{k} p JOIN h ON h.query_id = p.query_id AND h.point_id = p.point_id JOIN {{v_source}} s ON s.source_id = h.source_id
            WHERE coalesce(h.chunk_text, '') <> '' AND h.trust_level IS NOT NULL AND trim(coalesce(s.publisher, '')) <> '' AND trim(coalesce(s.license_info, '')) <> ''),
    final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mmr_rank) AS rank FROM got)
    """


@query(
    "retrieve_batch",
    f"""WITH {_retrieved_sql(5, "trust_level IN ('OFFICIAL_BINDING', 'OFFICIAL_GUIDANCE', 'OPEN_CURATED', 'USER_APPROVED')")}
        SELECT query_id, rank, point_id, source_id, title, round(score, 6) AS score,
               CASE WHEN trust_level IN ('OFFICIAL_BINDING', 'OFFICIAL_GUIDANCE') THEN 'GROUNDED' ELSE 'UNSUPPORTED_DRAFT' END AS confidence FROM final""",
)
def _(t):
    cited = retrieve_batch(t("v_query"), t("v_point"), t("v_source"), minimum="USER_APPROVED")
    return cited.select("query_id", F.col("rank").cast("bigint").alias("rank"), "point_id", "source_id", "title", F.round("score", 6).alias("score"), "confidence")


@query(
    "evaluate",
    f"""
    WITH {_retrieved_sql(10, "true")},
    hit AS (SELECT q.question_id, f.rank FROM final f JOIN {{v_question}} q ON q.question_id = f.query_id WHERE list_contains(q.expected_source_ids, f.source_id)),
    sc AS (SELECT q.question_id, q.domain, count(h.rank) FILTER (h.rank <= 5) / 5.0 AS p,
                  count(h.rank) FILTER (h.rank <= 10)::double / max(len(q.expected_source_ids)) AS r, coalesce(1.0::double / min(h.rank), 0) AS rr
           FROM {{v_question}} q LEFT JOIN hit h USING (question_id) WHERE q.status = 'active' GROUP BY 1, 2),
    su AS (SELECT domain, count(*) AS questions, avg(p) AS p5, avg(r) AS r10, avg(rr) AS mrr FROM sc GROUP BY domain
           UNION ALL SELECT NULL, count(*), avg(p), avg(r), avg(rr) FROM sc)
    SELECT domain, questions, round(p5, 6) AS p5, round(r10, 6) AS r10, round(mrr, 6) AS mrr,
           domain IS NULL AND 0.8 - p5 > 0.05 + 1e-9 AS p5_drift FROM su
    """,
)
def _(t):
    targets = [(None, "mean_precision_at_5", 0.8), (None, "mean_recall_at_10", 0.75), (None, "mean_reciprocal_rank", 0.7)]
    baseline = t.spark.createDataFrame(targets, "domain string, metric string, value double")
    _, summary, drifted = jobs.evaluate_job(t("v_question"), t("v_point"), t("v_source"), baseline, k=10)
    fallen = drifted.filter(F.col("metric") == "mean_precision_at_5").select(F.col("domain").alias("_d"), F.lit(True).alias("_f"))
    joined = summary.join(fallen, F.col("domain").eqNullSafe(F.col("_d")), "left")
    return joined.select(
        "domain",
        "questions",
        F.round("mean_precision_at_5", 6).alias("p5"),
        F.round("mean_recall_at_10", 6).alias("r10"),
        F.round("mean_reciprocal_rank", 6).alias("mrr"),
        F.coalesce("_f", F.lit(False)).alias("p5_drift"),
    )


@query(
    "govern_report",
    """
    WITH RECURSIVE chain AS (SELECT id AS root, id, status FROM {v_version} WHERE supersedes_id IS NULL
                   UNION ALL SELECT chain.root, v.id, v.status FROM {v_version} v JOIN chain ON v.supersedes_id = chain.id),
    c AS (SELECT count(*) AS chunks, count(DISTINCT source_id) AS indexed FROM {v_chunk}),
    s AS (SELECT count(*) AS total, count(*) FILTER (coalesce(license_info, '') NOT IN ('', '—')) AS licensed FROM {v_source} WHERE deleted_at IS NULL)
    SELECT 'index-chunks' AS check_id, chunks AS n FROM c UNION ALL SELECT 'index-sources', indexed FROM c
    UNION ALL SELECT 'index-coverage', cast(floor(licensed * 100.0 / total + 0.5) AS bigint) FROM s
    UNION ALL SELECT 'index-review', greatest(0, total - indexed) FROM c, s
    UNION ALL SELECT 'gov-unverified', count(*) FROM {v_source} WHERE deleted_at IS NULL AND trust_level = 'UNVERIFIED'
    UNION ALL SELECT 'gov-registered', count(*) FROM {v_source} WHERE deleted_at IS NULL AND lifecycle_status = 'REGISTERED' HAVING count(*) > 0
    UNION ALL SELECT 'gov-approved', count(*) FROM {v_source} WHERE deleted_at IS NULL AND lifecycle_status = 'APPROVED' HAVING count(*) > 0
    UNION ALL SELECT 'source-confession', count(*) FROM {v_source} WHERE NOT (subject IS NULL
         OR (subject = 'RELIGION' AND confession_context IN ('EVANGELISCH', 'KATHOLISCH', 'KONFESSIONSSENSIBEL_UEBERGREIFEND'))
         OR (subject = 'ETHIK' AND confession_context IN ('RELIGIONSKUNDLICH', 'NICHT_ANWENDBAR')) OR (subject = 'DEUTSCH' AND confession_context = 'NICHT_ANWENDBAR'))
    UNION ALL SELECT 'strand-rules', (SELECT count(*) FROM {v_strand} WHERE subject = 'DEUTSCH' AND confession_context <> 'NICHT_ANWENDBAR')
      + (SELECT count(*) FROM {v_strand} WHERE school_stage <> 'SEK_I' AND (school_form IS NOT NULL OR education_track IS NOT NULL))
      + (SELECT count(*) FROM {v_strand} WHERE education_track IS NOT NULL AND school_form IS NULL) + (SELECT count(*) FROM {v_strand} WHERE valid_to < valid_from)
    UNION ALL SELECT 'orphan-chunks', count(*) FROM {v_chunk} WHERE source_id NOT IN (SELECT source_id FROM {v_source})
    UNION ALL SELECT 'version-conflicts', count(*) FROM (SELECT root FROM chain WHERE status = 'ACTIVE' GROUP BY root HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate-content', count(*) FROM (SELECT count(*) OVER (PARTITION BY content_hash) AS k FROM {v_source}) WHERE k > 1
    """,
)
def _(t):
    return jobs.govern_report(t("v_source"), t("v_chunk"), t("v_strand"), t("v_version"))


@query(
    "generate_inputs_batch",
    f"""
    WITH g AS (SELECT r.request_id, min(g.grant_id) AS grant_id FROM {{v_request}} r JOIN {{v_grant}} g
            ON g.school_id = r.school_id AND g.provider = r.provider AND TIMESTAMP '{AS_OF}' BETWEEN g.valid_from AND g.valid_until
           AND (len(g.scope_subjects) = 0 OR list_contains(g.scope_subjects, r.subject))
           AND (len(g.scope_grade_bands) = 0 OR list_contains(g.scope_grade_bands, r.grade_band)) GROUP BY r.request_id),
    s AS (SELECT DISTINCT r.request_id FROM (SELECT *, upper(trim(school_form)) AS form,
                   CASE subject WHEN 'deutsch' THEN 'DEUTSCH' WHEN 'ethik' THEN 'ETHIK' ELSE 'RELIGION' END AS db_subject,
                   CASE subject WHEN 'deutsch' THEN 'NICHT_ANWENDBAR' WHEN 'ethik' THEN 'RELIGIONSKUNDLICH'
                        WHEN 'katholische-religion' THEN 'KATHOLISCH' ELSE 'EVANGELISCH' END AS context FROM {{v_request}}) r
      JOIN {{v_strand}} s ON s.status = 'ACTIVE' AND s.subject = r.db_subject AND s.confession_context = r.context
        AND (form NOT IN ('GESAMTSCHULE', 'GEMEINSCHAFTSSCHULE') OR s.school_form = form OR s.school_form IS NULL))
    SELECT r.request_id, CASE
             WHEN subject IN ('evangelische-religion', 'katholische-religion') AND coalesce(confession, '') = '' THEN 'CONFESSION_REQUIRED'
             WHEN subject = 'ethik' AND coalesce(confession, '') NOT IN ('', 'ethik') THEN 'CONFESSION_NOT_ALLOWED'
             WHEN s.request_id IS NULL THEN 'NO_STRAND'
             WHEN provider_kind = 'cloud' AND (school_id IS NULL OR g.grant_id IS NULL) THEN 'false' ELSE 'true' END AS status
    FROM {{v_request}} r LEFT JOIN s USING (request_id) LEFT JOIN g USING (request_id)
    """,
)
def _(t):
    # the query text of a request is embedded by the caller; here the mean of a label and subject stands for it
    own = F.coalesce("display_subject", F.lit("katholische-religion"))
    vectors = t("v_query").select("label", own.alias("subject"), "vector")
    requests = t("v_request").withColumn("constraints", text.parse_constraints("constraints_raw"))
    joined = requests.withColumn("label", (F.col("request_id") % 10).cast("int")).join(vectors, ["label", "subject"])
    ready, blocked, audit = jobs.generate_inputs_batch(
        joined, t("v_strand"), t("v_point"), t("v_source"), t("v_grant"), AS_OF, cloud_enabled=True, texts=PromptTexts()
    )
    return ready.select("request_id", F.col("allowed").cast("string").alias("status")).unionByName(
        blocked.select("request_id", F.col("blocked_reason").alias("status"))
    )


def _absorbed(t):
    statements = t("v_statement").groupBy("artifact_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "text", F.col("refs").alias("citationRefs")))),
            lambda s: F.struct(s["text"].alias("text"), s["citationRefs"].alias("citationRefs")),
        ).alias("statements")
    )
    ids = t("conversations").select(F.col("conv_id").alias("artifact_id")).distinct()
    responses = ids.join(statements, "artifact_id", "left").select(
        "artifact_id",
        F.lit("LESSON").alias("artifact_type"),
        F.lit("prompt").alias("prompt"),
        F.lit(False).alias("redaction_applied"),
        F.lit("teacher").alias("owner_id"),
        F.when(F.col("statements").isNull(), F.lit("no json here")).otherwise(
            F.concat(F.lit("```json\n"), F.to_json("statements"), F.lit("\n```"))
        ).alias("reply"),
    )
    wanted = ids.withColumn("difficulty", F.lit("Basis"))
    return jobs.absorb_responses(responses, t("v_citation"), wanted)


@query(
    "absorb_responses",
    f"""
    WITH {GROUNDED_SQL},
    k AS (SELECT artifact_id, count(*) AS total, count(*) FILTER (confidence = 'GROUNDED') AS grounded FROM grounded GROUP BY 1)
    SELECT 'counts' AS part, artifact_id, total AS a, grounded AS b FROM k
    UNION ALL SELECT 'links', artifact_id, count(DISTINCT source_id), NULL FROM cited GROUP BY artifact_id
    UNION ALL SELECT 'failure', conv_id, NULL, NULL FROM {{conversations}} GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') = 0
    UNION ALL SELECT 'phases', artifact_id, sum(least(4 * idx // n, 3))::bigint, NULL
      FROM (SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY position) - 1 AS idx, count(*) OVER (PARTITION BY artifact_id) AS n FROM {{v_statement}}) GROUP BY 2
    """,
)
def _(t):
    done = _absorbed(t)
    none = F.lit(None).cast("bigint")
    return (
        done.counts.select(F.lit("counts").alias("part"), "artifact_id", F.col("total").alias("a"), F.col("grounded").alias("b"))
        .unionByName(done.sheet_links.groupBy(F.col("worksheet_id").alias("artifact_id")).agg(F.count("*").alias("a")).select(F.lit("links").alias("part"), "artifact_id", "a", none.alias("b")))
        .unionByName(done.failures.select(F.lit("failure").alias("part"), "artifact_id", none.alias("a"), none.alias("b")))
        .unionByName(done.statements.groupBy("artifact_id").agg(F.sum("phase_index").alias("a")).select(F.lit("phases").alias("part"), "artifact_id", "a", none.alias("b")))
    )


@query(
    "absorb_trail",
    f"""
    WITH {GROUNDED_SQL},
    k AS (SELECT artifact_id, count(*) AS total, count(*) FILTER (confidence = 'GROUNDED') AS g FROM grounded GROUP BY 1),
    state AS (SELECT artifact_id, '{{{{"total":' || cast(total AS string) || ',"grounded":' || cast(g AS string) || ',"unsupportedDraft":' || cast(total - g AS string) || '}}}}' AS v FROM k),
    ids AS (SELECT artifact_id, string_agg(cast(source_id AS string), ',' ORDER BY source_id) AS v FROM (SELECT DISTINCT artifact_id, source_id FROM cited) GROUP BY 1),
    middle AS (SELECT artifact_id, position FROM (
      SELECT artifact_id, position, row_number() OVER (PARTITION BY artifact_id ORDER BY position) - 1 AS idx, count(*) OVER (PARTITION BY artifact_id) AS n FROM {{v_statement}})
      WHERE idx = n // 2)
    SELECT 'provenance' AS part, artifact_id, SHA256('prompt') || ' ' || state.v || ' ' || coalesce(ids.v, '') AS detail FROM state LEFT JOIN ids USING (artifact_id)
    UNION ALL SELECT 'audit', NULL, 'generation_lesson teacher {{{{"detail":"' || replace(v, '"', chr(92) || '"') || '"}}}}' FROM state
    UNION ALL SELECT DISTINCT 'task', artifact_id, 'Basis ' || cast(source_id AS string) FROM middle JOIN cited USING (artifact_id, position)
    """,
)
def _(t):
    done = _absorbed(t)
    ids = F.array_join(F.transform("source_refs", lambda x: x.cast("string")), ",")
    trail = F.concat(F.col("prompt_hash"), F.lit(" "), F.col("confidence_state"), F.lit(" "), ids)
    return (
        done.provenance.select(F.lit("provenance").alias("part"), "artifact_id", trail.alias("detail"))
        .unionByName(done.audit.select(F.lit("audit").alias("part"), F.lit(None).cast("bigint").alias("artifact_id"), F.concat_ws(" ", "event_type", "actor_id", "details").alias("detail")))
        .unionByName(done.task_links.select(F.lit("task").alias("part"), F.col("worksheet_id").alias("artifact_id"), F.concat_ws(" ", "difficulty", F.col("source_id").cast("string")).alias("detail")))
    )



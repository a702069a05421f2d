"""Registered queries: text, privacy and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.catalog.core import query
from attesta.catalog.dialect import GUARD_CASE, redaction_ctes
from attesta.catalog.views import AS_OF
from attesta.functions import governance as gov
from attesta.functions import privacy, text
from attesta.functions.hooks import embed, extract_hook
from attesta.plans.gateway import PromptTexts, prompt_assemble, redact_then_gate
from attesta.rules import WS

_WS2 = WS.replace("{", "{{").replace("}", "}}")


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS2}]+|[{_WS2}]+$', '', 'g')"


@query(
    "chunk_text",
    "SELECT source_id, chunk_index, page_or_section, length(chunk_text) AS characters, SHA256(chunk_text) AS content_hash FROM {v_piece}",
)
def _(t):
    return t("v_piece").select(
        "source_id", "chunk_index", "page_or_section", F.length("chunk_text").cast("bigint").alias("characters"), F.sha2("chunk_text", 256).alias("content_hash")
    )


@query(
    "chunk_text_tail_rule",
    """
    WITH c AS (SELECT doc_id, text, length(text) AS n, cast(ceil(greatest(length(text) - 500, 0) / 490.0) AS int) AS last FROM {documents} WHERE trim(text) <> ''),
         p AS (SELECT *, unnest(range(0, last + 1))::int AS i FROM c)
    SELECT doc_id, i AS chunk_index, SHA256(CASE WHEN i = last - 1 AND n - last * 490 < 50 THEN substring(text, i * 490 + 1, 500) || substring(text, last * 490 + 1, 500)
             ELSE substring(text, i * 490 + 1, 500) END) AS content_hash
    FROM p WHERE NOT (i = last AND last > 0 AND n - last * 490 < 50)
    """,
)
def _(t):
    rows = text.chunk_text(t("documents"), "text", keep=["doc_id"], size=500, overlap=10)
    return rows.select("doc_id", "chunk_index", F.sha2("chunk_text", 256).alias("content_hash"))


def _strip(x: str) -> str:
    for pattern in (r"(?i)<script[^>]*>[\s\S]*?</script>", r"(?i)<style[^>]*>[\s\S]*?</style>", "<[^>]+>"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return x


def _entities(x: str, order: str) -> str:
    chars = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "#039": "''"}
    for name in order.split():
        x = f"replace({x}, '&{name};', '{chars[name]}')"
    return x


_HTML_SQL = _trim(f"regexp_replace({_entities(_strip('html'), 'nbsp amp lt gt quot #039')}, '[{_WS2}]{{{{2,}}}}', ' ', 'g')")
_BLANK2 = _WS2.replace(r"\n", "").replace(r"\r", "")
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]"
_CLEAN_SQL = _trim(
    f"regexp_replace({_entities(_strip(f'''regexp_replace(html, '{_CONTROL}', '', 'g')'''), 'amp lt gt quot #039 nbsp')}, '[{_BLANK2}]{{{{2,}}}}', ' ', 'g')"
)


@query("html_to_text", f"SELECT page_id, length(x) AS characters, SHA256(x) AS text_hash FROM (SELECT page_id, {_HTML_SQL} AS x FROM {{pages}})")
def _(t):
    out = t("pages").select("page_id", text.html_to_text("html").alias("x"))
    return out.select("page_id", F.length("x").cast("bigint").alias("characters"), F.sha2("x", 256).alias("text_hash"))


@query("sanitize_text", f"SELECT page_id, length(x) AS characters, SHA256(x) AS text_hash FROM (SELECT page_id, {_CLEAN_SQL} AS x FROM {{pages}})")
def _(t):
    out = t("pages").select("page_id", text.sanitize_text("html").alias("x"))
    return out.select("page_id", F.length("x").cast("bigint").alias("characters"), F.sha2("x", 256).alias("text_hash"))


@query(
    "redact_pii",
    f"WITH {redaction_ctes('{v_personal}', 'doc_id')} SELECT doc_id, SHA256(x) AS text_hash, rtrim(hit, ',') AS categories, hit <> '' AS applied FROM m6",
)
def _(t):
    out = privacy.redact(t("v_personal"))
    return out.select(
        "doc_id", F.sha2("redacted_text", 256).alias("text_hash"), F.array_join("categories_hit", ",").alias("categories"), F.col("redaction_applied").alias("applied")
    )


@query("content_hash", "SELECT doc_id, SHA256(text) AS content_hash FROM {documents}")
def _(t):
    return t("documents").select("doc_id", text.content_hash("text").alias("content_hash"))


_INNER, _OUTER = privacy.hmac_pads("attesta-test-secret")


@query(
    "pseudonym_id",
    f"""SELECT request_id, translate(base64(unhex(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(cast(request_id AS string))))))), '+/', '-_') AS pseudonym
        FROM {{v_request}}""",
)
def _(t):
    return t("v_request").select("request_id", privacy.pseudonym_id("request_id", "attesta-test-secret").alias("pseudonym"))


@query(
    "humanize_event",
    "SELECT DISTINCT event_type, upper(substring(x, 1, 1)) || substring(x, 2) AS title FROM (SELECT event_type, lower(replace(event_type, '_', ' ')) AS x FROM {v_audit})",
)
def _(t):
    return t("v_audit").select("event_type", text.humanize_event("event_type").alias("title")).distinct()


@query(
    "relative_time",
    f"""
    SELECT event_id, CASE WHEN m < 1 THEN 'gerade eben' WHEN m < 60 THEN 'vor ' || cast(m AS string) || ' Min.' WHEN m < 1440 THEN 'vor ' || cast(m // 60 AS string) || ' Std.'
                WHEN m // 1440 = 1 THEN 'gestern' WHEN m // 1440 < 7 THEN 'vor ' || cast(m // 1440 AS string) || ' Tagen' ELSE strftime(ts, '%-d.%-m.%Y') END AS label
    FROM (SELECT event_id, ts, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) // 60000000 AS m FROM {{v_audit}})
    """,
)
def _(t):
    return t("v_audit").select("event_id", text.relative_time("ts", F.lit(AS_OF)).alias("label"))


@query(
    "json_detail",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'event ' || cast(event_id AS string) ELSE event_type END AS detail FROM {v_audit}",
)
def _(t):
    return t("v_audit").select("event_id", text.json_detail("details", F.col("event_type")).alias("detail"))


@query(
    "grade_of_band",
    """SELECT node_id, CASE WHEN try_cast(regexp_replace(coalesce(grade_band, ''), '[^0-9]', '', 'g') AS int) BETWEEN 5 AND 12
              THEN try_cast(regexp_replace(grade_band, '[^0-9]', '', 'g') AS int) ELSE 8 END AS grade FROM {v_strand_node}""",
)
def _(t):
    return t("v_strand_node").select("node_id", text.grade_of_band("grade_band").alias("grade"))


@query(
    "initials",
    """
    SELECT page_id, CASE WHEN len(parts) >= 2 THEN upper(substring(parts[1], 1, 1) || substring(parts[-1], 1, 1))
                         WHEN upper(substring(split_part(name, '@', 1), 1, 2)) = '' THEN '?' ELSE upper(substring(split_part(name, '@', 1), 1, 2)) END AS initials
    FROM (SELECT page_id, name, regexp_split_to_array(trim(name), ' +') AS parts
          FROM (SELECT page_id, replace(split_part(split_part(url, '://', 2), '/', 1), '.', CASE WHEN page_id % 2 = 0 THEN ' ' ELSE '@' END) AS name FROM {pages}))
    """,
)
def _(t):
    host = F.substring_index(F.substring_index(F.substring_index("url", "://", -1), "/", 1), "?", 1)
    names = t("pages").select("page_id", F.replace(host, F.lit("."), F.when(F.col("page_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("@"))).alias("name"))
    return names.select("page_id", text.initials("name").alias("initials"))


@query(
    "title_of_file",
    f"SELECT doc_id, {_trim('translate(x, chr(95) || chr(45), chr(32) || chr(32))')} AS title "
    "FROM (SELECT doc_id, CASE WHEN regexp_matches(n, '(?s)^.+\\.[^.]*$') THEN regexp_extract(n, '(?s)^(.+)\\.[^.]*$', 1) ELSE n END AS x "
    "FROM (SELECT doc_id, split_part(rel_path, '/', -1) AS n FROM {v_path}))",
)
def _(t):
    return t("v_path").select("doc_id", text.title_of_file("rel_path").alias("title"))


@query(
    "plan_slug",
    """
    SELECT doc_id, 'unterrichtsplanung-' || CASE WHEN s = '' THEN 'einheit' ELSE s END AS slug
    FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS s FROM {documents})
    """,
)
def _(t):
    return t("documents").select("doc_id", text.plan_slug("text").alias("slug"))


@query("snippet", "SELECT doc_id, CASE WHEN length(text) > 240 THEN substring(text, 1, 240) || '…' ELSE text END AS snippet FROM {documents}")
def _(t):
    return t("documents").select("doc_id", text.snippet("text").alias("snippet"))


@query("token_estimate", "SELECT doc_id, cast(ceil(length(text) / 4.0) AS bigint) AS tokens FROM {documents}")
def _(t):
    return t("documents").select("doc_id", text.token_estimate("text").alias("tokens"))


@query(
    "parse_constraints",
    """SELECT request_id, CASE request_id % 6 WHEN 0 THEN '45 Minuten|LRS' WHEN 1 THEN 'a|b|c' ELSE '' END AS constraints,
              cast(CASE request_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS bigint) AS n FROM {v_request}""",
)
def _(t):
    parsed = t("v_request").select("request_id", text.parse_constraints("constraints_raw").alias("c"))
    return parsed.select("request_id", F.array_join("c", "|").alias("constraints"), F.size("c").cast("bigint").alias("n"))


@query(
    "json_repair",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{{"k":1}}' WHEN 1 THEN props WHEN 2 THEN '{{"statements":[1, 2]}}' WHEN 3 THEN props ELSE NULL END AS repaired
       FROM {events}""",
)
def _(t):
    raw = (
        F.when(F.col("event_id") % 5 == 0, F.lit('Hier: {"k":1} und mehr'))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_id") % 5 == 2, F.lit(" [1, 2] "))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("\n"), "props"))
        .otherwise(F.col("event_type"))
    )
    return t("events").select("event_id", text.json_repair(raw).alias("repaired"))


@query(
    "prompt_assemble",
    """
    WITH c AS (SELECT artifact_id, string_agg('[' || cast(rank AS string) || '] ' || title || ' | chunk:' || cast(rank AS string) || ' | Trust: ' || trust_level, chr(10) ORDER BY rank) AS lines
               FROM {v_citation} GROUP BY artifact_id),
    r AS (SELECT request_id, 'KONTEXT:' || chr(10) || 'Fach: ' || subject || CASE subject WHEN 'evangelische-religion' THEN ' (evangelisch)' WHEN 'katholische-religion' THEN ' (katholisch)' ELSE '' END
            || chr(10) || 'Jahrgangsstufe / Klassenstufe: ' || grade_band || chr(10) || 'Thema: ' || topic
            || CASE request_id % 6 WHEN 0 THEN chr(10) || 'Besondere Rahmenbedingungen (verbindlich berücksichtigen): 45 Minuten; LRS' WHEN 1 THEN chr(10) || 'Besondere Rahmenbedingungen (verbindlich berücksichtigen): a; b; c' ELSE '' END
            || CASE WHEN request_id % 7 = 0 THEN chr(10) || 'Zusätzliche Anweisungen der Lehrkraft (verbindlich berücksichtigen): kurz' ELSE '' END AS ctx FROM {v_request})
    SELECT request_id, CASE WHEN lines IS NULL THEN 'NOSRC' || chr(10) || chr(10) || ctx || chr(10) || chr(10) || 'TASK' || chr(10) || chr(10) || 'OUT'
             ELSE 'SRC' || chr(10) || chr(10) || ctx || chr(10) || chr(10) || 'LIST:' || chr(10) || lines || chr(10) || chr(10) || 'TASK' || chr(10) || chr(10) || 'OUT' END AS prompt
    FROM r LEFT JOIN c ON c.artifact_id = r.request_id
    """,
)
def _(t):
    return prompts(t).select("request_id", "prompt")


def prompts(t):
    texts = PromptTexts(grounded="SRC", without_sources="NOSRC", sources_title="LIST:", task="TASK", output="OUT")
    # a request cites at most the turns of one conversation
    cited = t("v_citation").groupBy(F.col("artifact_id").alias("request_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", F.concat(F.lit("chunk:"), F.col("rank").cast("string")).alias("page_or_section"), "trust_level"))).alias("citations")
    )
    requests = t("v_request").withColumn("constraints", text.parse_constraints("constraints_raw"))
    return prompt_assemble(requests.join(cited, "request_id", "left"), texts)


@query(
    "grade_band_of_folder",
    r"""SELECT doc_id, CASE WHEN f LIKE 'sek\_kl5%' ESCAPE '\' THEN 'KS5' WHEN f LIKE 'sek\_kl7%' ESCAPE '\' THEN 'KS7' WHEN f LIKE 'sek\_kl9%' ESCAPE '\' THEN 'KS9' WHEN f = 'sek_2012' THEN 'KS9' END AS band
        FROM (SELECT doc_id, split_part(rel_path, '/', 2) AS f FROM {v_path})""",
)
def _(t):
    return t("v_path").select("doc_id", text.grade_band_of_folder(F.split("rel_path", "/")[1]).alias("band"))


_GATE_SQL = f"""
    g AS (SELECT r.request_id, min(g.grant_id) AS grant_id FROM {{v_request}} r JOIN {{v_grant}} g
            ON g.school_id = r.school_id AND g.provider = r.provider AND TIMESTAMP '{AS_OF}' BETWEEN g.valid_from AND g.valid_until
           AND (len(g.scope_subjects) = 0 OR list_contains(g.scope_subjects, r.subject))
           AND (len(g.scope_grade_bands) = 0 OR list_contains(g.scope_grade_bands, r.grade_band)) GROUP BY r.request_id),
    txt AS (SELECT doc_id AS request_id, x AS text, hit FROM m6),
    d AS (SELECT r.request_id, r.user_id, r.provider, r.school_id, g.grant_id, t.text, t.hit, r.provider_kind,
                 CASE WHEN r.provider_kind = 'cloud' AND (r.school_id IS NULL OR g.grant_id IS NULL) THEN 'NO_ACTIVE_GRANT' END AS route,
                 ({GUARD_CASE.replace('text,', 't.text,')}) IS NOT NULL AS residual
          FROM {{v_request}} r JOIN txt t USING (request_id) LEFT JOIN g USING (request_id))
"""


def gated(t):
    # dealt by id, so a table of one large row group is masked by all tasks; the requests are hashed, no texts are sorted
    requests = t("v_request").hint("shuffle_hash").join(t("v_personal").select(F.col("doc_id").alias("request_id"), F.col("text").alias("prompt")), "request_id")
    return redact_then_gate(requests, t("v_grant"), AS_OF, cloud_enabled=True)


@query(
    "redact_then_gate",
    f"""WITH {redaction_ctes('{v_personal}', 'doc_id')}, {_GATE_SQL}
        SELECT request_id, coalesce(route, CASE WHEN residual THEN 'RESIDUAL_PII' END) AS reason, route IS NULL AND NOT residual AS allowed, rtrim(hit, ',') AS categories,
               CASE WHEN route IS NULL AND NOT residual THEN SHA256(text) END AS text_hash FROM d""",
)
def _(t):
    decisions, _ = gated(t)
    return decisions.select(
        "request_id", "reason", "allowed", F.array_join("categories_hit", ",").alias("categories"), F.sha2("redacted_text", 256).alias("text_hash")
    )


@query(
    "gate_audit",
    f"""WITH {redaction_ctes('{v_personal}', 'doc_id')}, {_GATE_SQL}
        SELECT request_id, user_id AS actor_id, CASE WHEN route IS NOT NULL THEN 'llm_gate_cloud_blocked' WHEN provider_kind = 'local' THEN 'llm_gate_local_call' ELSE 'llm_gate_cloud_call' END AS event_type,
               CASE WHEN route IS NOT NULL THEN 'critical' ELSE 'info' END AS severity,
               CASE WHEN route IS NOT NULL THEN '{{{{"reason":"NO_ACTIVE_GRANT","provider":"' || provider || '","schoolId":'
                      || CASE WHEN school_id IS NULL THEN 'null,"note":"context or schoolId missing — fail-closed"' ELSE school_id::string END || '}}}}'
                    ELSE '{{{{"redactionApplied":' || CASE WHEN hit = '' THEN 'false' ELSE 'true' END || ',"categoriesHit":['
                      || CASE WHEN hit = '' THEN '' ELSE '"' || replace(rtrim(hit, ','), ',', '","') || '"' END || '],"provider":"' || provider || '"'
                      || CASE WHEN provider_kind = 'local' THEN '' ELSE ',"grantId":' || grant_id::string END || '}}}}' END AS detail FROM d
        UNION ALL SELECT request_id, user_id, 'llm_gate_pii_guard_fail', 'critical', '{{{{"reason":"RESIDUAL_PII","provider":"' || provider || '"}}}}'
        FROM d WHERE route IS NULL AND residual""",
)
def _(t):
    return gated(t)[1].select("request_id", "actor_id", "event_type", "severity", "detail")


@query(
    "embed",
    """SELECT chunk_id, length(chunk_text)::double AS characters, (length(chunk_text) - length(replace(chunk_text, 'e', '')))::double AS letters_e,
              (length(chunk_text) - length(replace(chunk_text, ' ', '')))::double AS blanks FROM {v_piece}""",
)
def _(t):
    def make_client():  # stands for the caller's service: a vector that SQL can state as well
        return lambda texts: [[len(x), x.count("e"), x.count(" ")] for x in texts]

    vectors = embed(t("v_piece").select("chunk_id", "chunk_text"), make_client)
    return vectors.select("chunk_id", *[F.col("vector")[i].alias(n) for i, n in enumerate(("characters", "letters_e", "blanks"))])


@query(
    "extract_hook",
    """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'ValueError: unsupported' END AS extract_error, CASE WHEN page_id % 4 = 3 THEN NULL ELSE length(html) END AS characters FROM {pages}""",
)
def _(t):
    def make_parser():
        def parse(payload: bytes, mime: str) -> str:
            if mime == "image/png":
                raise ValueError("unsupported")
            return payload.decode("utf-8")

        return parse

    files = t("pages").select(
        "page_id", F.encode("html", "UTF-8").alias("content"), F.when(F.col("page_id") % 4 == 3, F.lit("image/png")).otherwise(F.lit("text/html")).alias("mime")
    )
    out = extract_hook(files, make_parser)
    return out.select("page_id", "extract_error", F.length("extracted_text").cast("bigint").alias("characters"))


@query(
    "source_labels",
    """SELECT source_id, CASE WHEN subject IS NULL THEN NULL WHEN subject = 'DEUTSCH' THEN 'Deutsch' WHEN subject = 'ETHIK' THEN 'Ethik' WHEN confession_context = 'KATHOLISCH' THEN 'Kath. Religion' ELSE 'Ev. Religion' END AS label
       FROM {v_source}""",
)
def _(t):
    shown = F.when(F.col("subject").isNotNull(), gov.subject_label(gov.display_subject("subject", "confession_context")))
    return t("v_source").select("source_id", shown.alias("label"))

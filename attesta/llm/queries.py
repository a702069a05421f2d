"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import (
    decontam,
    exact_dedup,
    license_scan,
    lm,
    mixing,
    ngram_join,
    quality,
    sharding,
    substring,
    url_filter,
    vector_codes,
    warc,
    whitening,
)
from attesta.session import apply_settings, stage_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40
QUALITY_CUT = 0.3
MIX_SHARE = 0.6
MIX_POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def query(key: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(apply_settings(spark), folder)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_of_id(id_: str = "doc_id"):
    return F.crc32(F.col(id_).cast("string"))


@query("op1_mixing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), MIX_SHARE, MIX_POWERS, mixing.register("text"))
    return mixed.select("doc_id", "tokens", *mixing.DIMENSIONS, "weight", "probability", "sampled")


@query("op2_sharding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substring.shared_passages(table(spark, folder, "documents"))


@query("op8_lm_scoring")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(table(spark, folder, "documents"), "crc32(cast(doc_id AS string)) % 7 <> 2")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


@query(
    "op3_ngram_join",
    f"""
    WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
    tokens AS MATERIALIZED (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
    links AS MATERIALIZED (
      SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM tokens x JOIN tokens y USING (s)
                        WHERE x.doc_id <> y.doc_id GROUP BY ALL)
      JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


FIRST_DAY = "2024-01-01"


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a fetch day: the table has none, so it is spread over a year by the page number."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    return table(spark, folder, "pages").select("page_id", "url", day.alias("fetched"))


def list_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Dated list entries over the hosts and pages that occur: which ones and when follows from their MD5.

    A quarter of the domains is listed for a while, half of these a second time for good; a
    sixteenth of the hosts and of the pages is listed for good. Names that advertise are
    listed from the first day on.
    """
    pages = captures(spark, folder)
    hosts = pages.select(url_filter.host_of("url").alias("host")).filter(F.col("host").isNotNull()).distinct()
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    domains = hosts.select(F.when(domain == "", F.col("host")).otherwise(domain).alias("value")).distinct()

    def hashed(frame: DataFrame) -> DataFrame:
        part = lambda at: F.conv(F.substring(F.md5("value"), at, 2), 16, 10).cast("int")
        return frame.select("value", part(1).alias("pick"), part(3).alias("day"), part(5).alias("more"))

    def entry(frame: DataFrame, name: str, kind: str, action: str, day) -> DataFrame:
        return frame.select(
            F.lit(name).alias("list"),
            F.lit(kind).alias("kind"),
            "value",
            F.lit(action).alias("action"),
            F.date_add(F.lit(FIRST_DAY).cast("date"), day).alias("at"),
        )

    some = hashed(domains).filter(F.col("pick") < 64)
    twice = some.filter(F.col("more") % 2 == 0)
    own = hashed(hosts.select(F.col("host").alias("value"))).filter(F.col("pick") < 16)
    page = hashed(pages.select(url_filter.page_of("url").alias("value")).filter(F.col("value").isNotNull()).distinct())
    spam = domains.filter(F.col("value").rlike("pills|bets|casino|spam"))
    return (
        entry(some, "abuse", "domain", "add", F.col("day"))
        .unionByName(entry(some, "abuse", "domain", "remove", F.col("day") + F.lit(10) + F.col("more") % 50))
        .unionByName(entry(twice, "abuse", "domain", "add", F.col("day") + F.lit(90)))
        .unionByName(entry(own, "malware", "host", "add", F.col("day")))
        .unionByName(entry(page.filter(F.col("pick") < 16), "takedown", "url", "add", F.col("day")))
        .unionByName(entry(spam, "spam", "domain", "add", F.lit(0)))
    )


_HOST = r"nullif(regexp_replace(regexp_extract(lower(url), '^\s*https?://(?:[^/?#@]*@)?([^/?#:\s]+)', 1), '\.+$', ''), '')"
_PAGE = _HOST + r" || regexp_replace(regexp_extract(url, '(?i)^\s*https?://[^/?#]*(/[^?#]*)', 1), '/+$', '')"


@query(
    "op5_url_filter",
    rf"""
    WITH captures AS (
      SELECT page_id, {_HOST} AS host, {_PAGE} AS page,
             DATE '{FIRST_DAY}' + CAST(page_id * 7919 % 366 AS INT) AS fetched FROM pages),
    hosts AS (SELECT DISTINCT host AS value FROM captures WHERE host IS NOT NULL),
    domains AS (SELECT DISTINCT CASE WHEN d = '' THEN value ELSE d END AS value
                FROM (SELECT value, regexp_extract(value, '([^.]+\.[^.]+\.[^.]+)$', 1) AS d FROM hosts)),
    named AS (SELECT 'domain' AS kind, value FROM domains UNION ALL SELECT 'host', value FROM hosts
              UNION ALL SELECT DISTINCT 'url', page FROM captures WHERE page IS NOT NULL),
    hashed AS (SELECT kind, value, ('0x' || substr(md5(value), 1, 2))::INT AS pick, ('0x' || substr(md5(value), 3, 2))::INT AS day,
                      ('0x' || substr(md5(value), 5, 2))::INT AS more FROM named),
    entries AS (
      SELECT 'abuse' AS list, kind, value, true AS up, day AS dated FROM hashed WHERE kind = 'domain' AND pick < 64
      UNION ALL SELECT 'abuse', kind, value, false, day + 10 + more % 50 FROM hashed WHERE kind = 'domain' AND pick < 64
      UNION ALL SELECT 'abuse', kind, value, true, day + 90 FROM hashed WHERE kind = 'domain' AND pick < 64 AND more % 2 = 0
      UNION ALL SELECT 'malware', kind, value, true, day FROM hashed WHERE kind = 'host' AND pick < 16
      UNION ALL SELECT 'takedown', kind, value, true, day FROM hashed WHERE kind = 'url' AND pick < 16
      UNION ALL SELECT 'spam', kind, value, true, 0 FROM hashed
                WHERE kind = 'domain' AND regexp_matches(value, 'pills|bets|casino|spam')),
    spans AS (
      SELECT list, kind, value, DATE '{FIRST_DAY}' + dated AS since, DATE '{FIRST_DAY}' + until AS until
      FROM (SELECT *, lead(dated) OVER (PARTITION BY list, kind, value ORDER BY dated) AS until FROM entries) WHERE up),
    hits AS (
      SELECT page_id, list, since FROM captures c JOIN spans s
        ON ((s.kind = 'host' AND s.value = c.host) OR (s.kind = 'url' AND s.value = c.page)
            OR (s.kind = 'domain' AND (s.value = c.host OR ends_with(c.host, '.' || s.value))))
       AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)),
    firsts AS (
      SELECT page_id, count(*) OVER (PARTITION BY page_id) AS matches, list, since,
             row_number() OVER (PARTITION BY page_id ORDER BY since, list) AS rn FROM hits)
    SELECT c.page_id, c.host, f.page_id IS NOT NULL AS blocked, coalesce(f.matches, 0) AS matches,
           f.list AS first_list, strftime(f.since, '%Y-%m-%d') AS listed_since
    FROM captures c LEFT JOIN firsts f ON f.page_id = c.page_id AND f.rn = 1
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = url_filter.filter_captures(captures(spark, folder), list_entries(spark, folder), "page_id", "url", "fetched")
    return found.withColumn("listed_since", F.date_format("listed_since", "yyyy-MM-dd"))


@query(
    "op6_exact_dedup",
    r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query(
    "op9_decontamination",
    f"""
    WITH words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
    tests AS MATERIALIZED (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    grams AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
              FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tests)),
    sizes AS (SELECT item_id, count(*) AS n FROM grams GROUP BY item_id),
    tokens AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
               FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM words, (SELECT DISTINCT k FROM tests)))
    SELECT doc_id, item_id, n::INT AS item_shingles, count(*)::INT AS shared, round(count(*) / n, 6) AS containment
    FROM tokens JOIN grams USING (k, s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    trees = quality.train(docs, labels.filter(crc_of_id() % 5 != 0))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    scored = quality.score_documents(rows, trees)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0).alias("predicted"))


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


def _codes_sql(parts: int, entries: int, rounds: int, width: int = 64) -> str:
    """The product codes as SQL: a named table per round of codebooks, one row per vector, part and position."""
    length = width // parts

    def nearest(book: str) -> str:
        return f"""
        SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
          SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(range(1, {length + 1}),
                 lambda i: (p.piece[i] - b.piece[i]) * (p.piece[i] - b.piece[i])))::BIGINT AS d
          FROM pieces p JOIN {book} b USING (part)) GROUP BY vec_id, part"""

    # DuckDB's // truncates: the floor of a negative quotient needs the remainder
    mean = "(sum(piece[pos]) - ((sum(piece[pos]) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = []
    for i in range(rounds):
        steps.append(f"""
        near{i} AS MATERIALIZED ({nearest(f"book{i}")}),
        book{i + 1} AS MATERIALIZED (
          SELECT b.part, b.entry, coalesce(m.piece, b.piece) AS piece FROM book{i} b LEFT JOIN (
            SELECT part, entry, list(v ORDER BY pos) AS piece FROM (
              SELECT part, entry, pos, ({mean})::BIGINT AS v
              FROM near{i} JOIN pieces USING (vec_id, part), (SELECT unnest(range(1, {length + 1})) AS pos)
              GROUP BY part, entry, pos) GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)""")
    body = ",".join(steps)
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    pieces AS MATERIALIZED (
      SELECT vec_id, part, x[part * {length} + 1 : part * {length} + {length}] AS piece
      FROM kept, (SELECT unnest(range(0, {parts})) AS part)),
    book0 AS MATERIALIZED (
      SELECT part, entry, piece FROM pieces
      JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
    {body},
    last AS MATERIALIZED ({nearest(f"book{rounds}")}),
    coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id),
    digest AS (SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds})
    SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h AS codebooks_sha256
    FROM coded c JOIN kept k ON k.vec_id = c.vec_id, digest
    """


@query("op12_vector_codes", _codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


@query(
    "op13_warc",
    """
    SELECT page_id, bytes AS payload_bytes, sha1(body) AS payload_digest,
           CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> keep THEN keep END AS refers_to
    FROM (SELECT page_id, body, bytes, CASE WHEN bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS keep
          FROM (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS bytes FROM pages))
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = stage_folder(spark)
    warc.archive_pages(table(spark, folder, "pages"), f"{path}/archive")
    warc.write_warc(warc.restore(spark, f"{path}/archive"), f"{path}/files")
    rows = warc.resolved(warc.read_warc(spark, f"{path}/files"))
    return rows.select(
        F.col("source_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )

"""WARC records in a content-addressed archive, and WARC files.

An archive is a folder with two tables: ``payloads`` holds the bytes of every distinct
payload once, by SHA-256, and ``headers`` the exact other bytes of every record with the
digest of what belongs between them. Records come back through a join. WARC files are plain
or gzip files of whole records, cut so that none is much larger than asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import spread, staged

LEAST_BYTES = 1000
FILE_BYTES = 32 << 20
BROADCAST_ROWS = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
SCHEMA = "head binary, http binary, payload binary"
_HEAD_END = b"\r\n\r\n"
_READ = 1 << 20


class BadArchive(ValueError):
    """Bytes that are no whole WARC records, or a payload that is not what its digest says."""


def payload_facts(df: DataFrame, id_: str, url: str, payload: Column) -> DataFrame:
    """Stored: row, id, url, bytes, sha1 and sha256 of each payload; the payload itself is not stored."""
    body = F.coalesce(payload, F.lit(b""))
    return staged(
        spread(df).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_).alias("id"),
            F.col(url).cast("string").alias("url"),
            F.octet_length(body).cast("bigint").alias("bytes"),
            F.sha1(body).alias("sha1"),
            F.sha2(body, 256).alias("digest"),
        )
    )


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def roles(facts: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Facts with keep_row and keep_id: of equal payloads of at least ``least`` bytes the row with the largest id
    (null ids are the smallest, of equal ids the first row); null for that row itself and for smaller payloads.
    """
    large = facts.filter(F.col("bytes") >= least)
    best = large.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", (-F.col("row")).alias("last"))).alias("best"))
    repeated = staged(best.filter("n > 1").select("digest", F.col("best.id").alias("_keep"), (-F.col("best.last")).alias("_row")))
    found = facts.join(_few(repeated), "digest", "left")
    other = F.col("_row") != F.col("row")
    return found.select(
        *facts.columns, F.when(other, F.col("_row")).alias("keep_row"), F.when(other, F.col("_keep")).alias("keep_id")
    )


def record_id(row: Column, digest: Column) -> Column:
    """A URN from the row and its payload: the same for the same table, another for every row."""
    h = F.md5(F.concat_ws("/", row.cast("string"), digest))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _one_line(value: Column) -> Column:
    """Line breaks of a header's value are percent-encoded, so it cannot end its line."""
    for c, code in (("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(c), F.lit(code))
    return value


def records(facts_with_roles: DataFrame, date: str = NO_DATE, content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """head, http and digest of one record per row, as bytes but for the digest.

    A ``response`` has the digest of its payload; a ``revisit`` names the record that it refers to,
    keeps its HTTP head and has no payload, so its digest is null. Null urls have no
    Target-URI line, null ids no WARC-Source-ID line (a field of this library).
    """
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    revisit = F.col("keep_row").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}"),
        line("Content-Type", F.lit(content_type)),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit(CRLF),
    )
    block = F.octet_length("_http") + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("row"), F.col("digest"))),
        line("WARC-Source-ID", F.col("id").cast("string")),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("keep_row"), F.col("digest")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )
    built = facts_with_roles.withColumn("_http", http)
    return built.select(
        F.encode(head, "UTF-8").alias("head"),
        F.encode("_http", "UTF-8").alias("http"),
        F.when(~revisit, F.col("digest")).alias("digest"),
    )


def distinct_payloads(df: DataFrame, payload: Column, facts: DataFrame) -> DataFrame:
    """digest and payload, once per digest; only payloads that occur more than once are shuffled."""
    body = F.coalesce(payload, F.lit(b""))
    all_ = df.select(F.sha2(body, 256).alias("digest"), body.alias("payload"))
    repeated = staged(facts.groupBy("digest").count().filter("count > 1").select("digest"))
    few = _few(repeated)
    once = all_.join(few, "digest", "left_anti")
    more = all_.join(few, "digest", "left_semi").groupBy("digest").agg(F.first("payload").alias("payload"))
    return once.unionByName(more)


def write_archive(headers: DataFrame, payloads: DataFrame, path: str) -> None:
    """The two tables of an archive. ``headers`` has head, http and digest, ``payloads`` digest and payload.

    Headers are written last: a folder with headers is whole.
    """
    payloads.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    headers.select("head", "http", "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def store(parsed: DataFrame, path: str) -> None:
    """Any parsed records (head, http, payload) as an archive; every payload's bytes are kept once."""
    held = staged(parsed.select("head", "http", "payload"))
    digest = F.sha2("payload", 256)
    facts = held.filter("payload IS NOT NULL").select(digest.alias("digest"))
    payloads = distinct_payloads(held.filter("payload IS NOT NULL"), F.col("payload"), facts)
    write_archive(held.select("head", "http", digest.alias("digest")), payloads, path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """head, http and payload of every record of an archive, byte by byte as they were.

    Payloads are verified against their digest as they are read; one that differs or is
    missing raises. Records without payload take no part in the join.
    """
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload is not what its digest says: "), F.col("digest"))).cast("binary")
    checked = stored.select(
        "digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload")
    )
    lost = F.raise_error(F.concat(F.lit("no payload of digest "), F.col("digest"))).cast("binary")
    full = headers.filter("digest IS NOT NULL").join(checked, "digest", "left")
    full = full.select("head", "http", F.coalesce(F.col("payload"), lost).alias("payload"))
    bare = headers.filter("digest IS NULL").select("head", "http", F.lit(None).cast("binary").alias("payload"))
    return full.unionByName(bare)


def _files(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    size = 0
    for batch in batches:
        for head, http, payload in zip(*(batch.column(c) for c in ("head", "http", "payload")), strict=True):
            record = b"".join(x.as_py() or b"" for x in (head, http, payload)) + _HEAD_END
            if parts and size + len(record) > most:
                yield pa.record_batch([pa.array([b"".join(parts)[:-2]], pa.binary())], names=["content"])
                parts, size = [], 0
            parts.append(record)
            size += len(record)
    if parts:
        yield pa.record_batch([pa.array([b"".join(parts)[:-2]], pa.binary())], names=["content"])


def write_warc(parsed: DataFrame, path: str, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Records (head, http, payload) as WARC files of at most ``file_bytes`` each, or one larger record.

    Spark's text writer puts the bytes into the files as they are: each file is one
    row, whose last line break is the separator that the writer adds.
    """
    files = parsed.select("head", "http", "payload").mapInArrow(lambda b: _files(b, file_bytes), "content binary")
    writer = files.select(F.col("content").cast("string").alias("value")).write
    writer.option("lineSep", CRLF).option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def _pieces(content: pa.Scalar) -> Iterator[bytes]:
    """The bytes of a file, decompressed piece by piece if they are one or more gzip members."""
    data = memoryview(content.as_buffer())
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[at : at + _READ]) for at in range(0, len(data), _READ))
        return
    while len(data):
        member = zlib.decompressobj(wbits=31)
        for at in range(0, len(data), _READ):
            yield member.decompress(data[at : at + _READ])
            if member.eof:
                data = data[min(at + _READ, len(data)) - len(member.unused_data) :]
                break
        else:
            raise BadArchive("a compressed file ends early")


def _field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def _split(head: bytes, block: bytes) -> tuple[bytes, bytes | None, bytes | None]:
    """(head, http, payload): records of HTTP messages are cut behind the HTTP head, others have none."""
    if not (_field(head, b"content-type") or b"").lower().startswith(b"application/http"):
        return head, None, block
    end = block.find(_HEAD_END)
    http, payload = (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])
    revisit = (_field(head, b"warc-type") or b"").lower() == b"revisit"
    return head, http, (None if revisit and not payload else payload)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes | None, bytes | None]]:
    """The records of one file; memory holds one record and one piece at a time."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        end, seen = held.find(_HEAD_END), 0
        while end < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise BadArchive("a record's header does not end")
            end = held.find(_HEAD_END, max(seen - 3, 0))
        head = bytes(held[: end + 4])
        length = _field(head, b"content-length")
        if not head.startswith(b"WARC/") or length is None or not length.isdigit():
            raise BadArchive(f"not a WARC record: {head[:60]!r}")
        stop = len(head) + int(length)
        if not fill(stop + 4) or held[stop : stop + 4] != _HEAD_END:
            raise BadArchive("a record's block does not end where its length says")
        yield _split(head, bytes(held[len(head) : stop]))
        del held[: stop + 4]


def _parsed(batches: Iterator[pa.RecordBatch], most: int = 16 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    def batch(found: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["head", "http", "payload"])

    for files in batches:
        for content in files.column("content"):
            found, size = [], 0
            for record in parse(_pieces(content)):
                found.append(record)
                size += sum(len(x or b"") for x in record)
                if size >= most or len(found) >= rows:
                    yield batch(found)
                    found, size = [], 0
            if found:
                yield batch(found)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """head, http and payload of every record of the WARC files in a folder, plain or gzip.

    head and http end with their blank line, so head, http, payload and two line breaks
    are the record's bytes. payload is null for a revisit without one; records that are no HTTP
    messages have a null http. Bytes that are no whole records raise ``BadArchive``. One file is read
    whole by one task.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, SCHEMA)


def header(name: str, head: str = "head") -> Column:
    """The value of a header field of the records, or null."""
    found = F.regexp_extract(F.decode(F.col(head), "UTF-8"), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def resolved(parsed: DataFrame) -> DataFrame:
    """source_id, payload_bytes, payload_digest, record_type, refers_to of parsed records.

    Bytes and digest of a response are measured on its payload; another one in its header
    raises, if written as hex SHA-1. A revisit has those of the record it refers to, and no bytes
    where the archive lacks that record.
    """
    named = F.lower(F.regexp_extract(header("WARC-Payload-Digest"), "(?i)^sha1:([0-9a-f]{40})$", 1))
    own = F.sha1("payload")
    wrong = F.raise_error(F.concat(F.lit("payload is not what its header says: "), named)).cast("string")
    facts = staged(
        parsed.select(
            header("WARC-Record-ID").alias("record"),
            header("WARC-Source-ID").alias("source_id"),
            header("WARC-Type").alias("record_type"),
            header("WARC-Refers-To").alias("_to"),
            named.alias("named"),
            F.octet_length("payload").cast("bigint").alias("bytes"),
            F.when(F.col("payload").isNotNull(), F.when((own == named) | named.isNull() | (named == ""), own).otherwise(wrong)).alias("sha1"),
        )
    )
    revisits = facts.filter("_to IS NOT NULL").select("source_id", "record_type", "_to", "named")
    wanted = _few(staged(revisits.select(F.col("_to").alias("record")).distinct()))
    kept = staged(
        facts.join(wanted, "record", "left_semi").select(
            F.col("record").alias("_to"), F.col("source_id").alias("refers_to"), "bytes", "sha1"
        )
    )
    differs = F.raise_error(F.concat(F.lit("a revisit refers to other bytes: "), F.col("_to"))).cast("string")
    seen = revisits.join(_few(kept), "_to", "left").select(
        "source_id",
        F.col("bytes").alias("payload_bytes"),
        F.when(F.col("named") == F.coalesce("sha1", "named"), F.col("named")).otherwise(differs).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    own = facts.filter("_to IS NULL").select(
        "source_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("string").alias("refers_to"),
    )
    return own.unionByName(seen)


def archive_pages(
    df: DataFrame, path: str, id_: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES
) -> None:
    """One WARC record per row, in a content-addressed archive at ``path``.

    The payload is the text in UTF-8 (null: empty). Of equal payloads of at least ``least``
    bytes that of the largest id is a response, and the others revisit it; smaller ones are all
    responses, whose bytes are stored once all the same. Null ids are smaller than others; of
    repeated rows the first is taken. An empty table gives an empty archive; other columns are not read.
    """
    payload = F.encode(F.col(html), "UTF-8")
    facts = payload_facts(df, id_, url, payload)
    write_archive(records(roles(facts, least)), distinct_payloads(df, payload, facts), path)

"""The WARC archive: exact round trips, roles against a plain version, damage that is found."""

import gzip
import hashlib
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attesta.llm import warc

SCHEMA = "page_id bigint, url string, html string, row int, digest string, head string, payload string, bytes int"
REST = (1, "d", "h", "p", 2)


def pages() -> list[tuple]:
    rng = random.Random(9)
    big = ["".join(rng.choice("abc é\r\n<") for _ in range(1200)) + str(i) for i in range(4)]
    rows = [(i, f"http://h/{i}", rng.choice([*big, "x" * 999, "x" * 1000, "", None, f"own {i}", "WARC/1.1\r\n\r\n\r\n\r\n"])) for i in range(150)]
    rows += [rows[3], rows[3], (7, "http://other", big[0]), (None, "http://none", big[0]), (None, "http://none", big[1])]
    rows += [(500, None, "no url"), (501, "http://a\r\nWARC-Type: metadata", "é" * 500), (502, "http://é", "é" * 499), (503, "u", "z" * 3_000_000)]
    rows += [(600, "only here", "q" * 2000)] * 3
    return [(*r, *REST) for r in rows]


def plain(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[(r[2] or "").encode()].append((r[0] if r[0] is not None else -1, i))
    out = []
    for body, members in groups.items():
        large = len(body) >= 1000
        top = max(m[0] for m in members)
        sha1 = hashlib.sha1(body).hexdigest()
        responses = 1 if large else len(members)
        kept = sorted(members, reverse=True)[:responses]
        out += [(m[0], len(body), sha1, "response", None) for m in kept]
        out += [(m[0], len(body), sha1, "revisit", top) for m in sorted(members, reverse=True)[responses:]]
    return sorted(out, key=repr)


@pytest.fixture
def archive(spark, tmp_path):
    warc.archive_pages(spark.createDataFrame(pages(), SCHEMA).repartition(6), f"{tmp_path}/archive")
    return f"{tmp_path}/archive"


def resolve(frame) -> list[tuple]:
    rows = [
        (int(r.source_id) if r.source_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        for r in warc.resolved(frame).collect()
    ]
    return sorted(((*r[:4], None if r[4] is None else int(r[4])) for r in rows), key=repr)


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("limit", [warc.BROADCAST_ROWS, 0])
def test_pages_round_trip(spark, tmp_path, archive, compression, limit, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    warc.write_warc(warc.restore(spark, archive), f"{tmp_path}/files", 100_000, compression)
    sizes = [len(gzip.decompress(p.read_bytes()) if compression == "gzip" else p.read_bytes()) for p in Path(tmp_path, "files").glob("part-*")]
    assert len(sizes) > 3 and sum(s > 100_000 for s in sizes) == 1  # the page of 3 MB
    back = warc.read_warc(spark, f"{tmp_path}/files")
    assert resolve(back) == plain(pages())
    again = sorted(bytes(r.head) + bytes(r.http or b"") + bytes(r.payload or b"") for r in back.collect())
    assert again == sorted(bytes(r.head) + bytes(r.http or b"") + bytes(r.payload or b"") for r in warc.restore(spark, archive).collect())
    heads = [r.head.decode() for r in back.collect()]
    assert len({h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads}) == len(pages())
    assert not any("\r\nWARC-Type: metadata" in h for h in heads)


def test_payloads_are_stored_once(spark, archive):
    stored = spark.read.parquet(f"{archive}/payloads").collect()
    bodies = {(r[2] or "").encode() for r in pages()}
    assert len(stored) == len(bodies) and {bytes(r.payload) for r in stored} == bodies
    assert all(hashlib.sha256(r.payload).hexdigest() == r.digest for r in stored)
    assert "payload" not in spark.read.parquet(f"{archive}/headers").columns


def test_any_records_come_back_byte_by_byte(spark, tmp_path):
    """Foreign files: several gzip members, odd header spelling, bytes that are no text, records of other kinds."""
    raw = bytes(range(256)) * 5
    http = b"HTTP/1.1 200 OK\r\nX: \xff\xfe\r\n\r\n"

    def record(kind: bytes, content_type: bytes, block: bytes, more: bytes = b"") -> bytes:
        return b"WARC/1.0\r\nwarc-type:" + kind + b"\r\n" + more + b"Content-type: " + content_type + b"\r\nContent-Length:   %d\r\n\r\n" % len(block) + block

    one = [
        record(b"warcinfo", b"application/warc-fields", b"software: x\r\n\r\n\r\n"),
        record(b"response", b"application/http; msgtype=response", http + raw),
        record(b"response", b"application/http; msgtype=response", http + raw, b"WARC-Date: x\r\n"),
        record(b"revisit", b"application/http", http),
        record(b"resource", b"image/png", raw),
        record(b"response", b"application/http", b"no blank line"),
        record(b"metadata", b"text/plain", b""),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in one))
    (folder / "b.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in one[:2]))
    (folder / "empty.warc").write_bytes(b"")
    parsed = warc.read_warc(spark, str(folder))
    warc.store(parsed, f"{tmp_path}/store")
    assert {bytes(r.payload) for r in spark.read.parquet(f"{tmp_path}/store/payloads").collect()} == {raw, b"software: x\r\n\r\n\r\n", b""}
    warc.write_warc(warc.restore(spark, f"{tmp_path}/store"), f"{tmp_path}/out", compression="none")
    whole = b"".join(p.read_bytes() for p in Path(tmp_path, "out").glob("part-*"))
    want = one + one[:2]
    assert len(whole) == sum(len(r) + 4 for r in want) and all(whole.count(r + b"\r\n\r\n") >= want.count(r) for r in want)


@pytest.mark.parametrize(
    "damage",
    [
        lambda b: b[:-3],
        lambda b: b.replace(b"Content-Length: ", b"Content-Length: 1", 1),
        lambda b: b"x" + b,
        lambda b: b.replace(b"Content-Length", b"Content-Width"),
        lambda b: b[: len(b) // 2],
    ],
)
def test_broken_files_raise(damage):
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert len(list(warc.parse(iter([record[:7], record[7:], record])))) == 2
    with pytest.raises(warc.BadArchive):
        list(warc.parse(iter([damage(record)])))


def test_wrong_and_lost_payloads_raise(spark, tmp_path, archive):
    payloads = spark.read.parquet(f"{archive}/payloads")
    headers = spark.read.parquet(f"{archive}/headers")
    bad = payloads.withColumn("payload", F.when(F.octet_length("payload") == 1000, F.lit(b"changed")).otherwise(F.col("payload")))
    warc.write_archive(headers, bad, f"{tmp_path}/bad")
    with pytest.raises(Exception, match="not what its digest says"):
        warc.restore(spark, f"{tmp_path}/bad").collect()
    warc.write_archive(headers, payloads.filter(F.octet_length("payload") != 1000), f"{tmp_path}/lost")
    with pytest.raises(Exception, match="no payload of digest"):
        warc.restore(spark, f"{tmp_path}/lost").collect()


def test_empty_table(spark, tmp_path):
    warc.archive_pages(spark.createDataFrame([], SCHEMA), f"{tmp_path}/archive")
    warc.write_warc(warc.restore(spark, f"{tmp_path}/archive"), f"{tmp_path}/files")
    assert resolve(warc.read_warc(spark, f"{tmp_path}/files")) == []

"""Exact deduplication on an index of cuckoo filters, one filter per segment of the digest space.

The index is a table. A segment has one filter row (``slots``) and one row per live digest
(``digest``, ``keep_id``, ``copies``): the content that a filter hit is checked against. A
segment is read, changed and written by one task, so a lost executor costs one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import staged

SLOTS = 4
KICKS = 200
SEGMENT_KEYS = 200_000
INDEX = "segment int, digest binary, keep_id bigint, copies bigint, slots binary, resizes int"
CHANGES = "digest binary, keep_id bigint, copies bigint, insert boolean"


class CuckooFilter:
    """A set of 16-bit fingerprints in buckets of four; each key has two buckets."""

    def __init__(self, buckets: int = 64, slots: np.ndarray | None = None):
        self.slots = [0] * (buckets * SLOTS) if slots is None else slots.tolist()
        self.mask = len(self.slots) // SLOTS - 1

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[10:18], "little") & self.mask
        return mark, one, self.other(one, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def find(self, digest: bytes) -> int:
        """The slot of the key's fingerprint, or -1."""
        mark, one, two = self.places(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[slot] == mark:
                    return slot
        return -1

    def insert(self, digest: bytes) -> bool:
        """False on overflow: a fingerprint then has no slot and the filter must be rebuilt."""
        mark, one, two = self.places(digest)
        bucket = one
        for kick in range(KICKS):
            for at in (one, two) if kick == 0 else (bucket,):
                for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                    if self.slots[slot] == 0:
                        self.slots[slot] = mark
                        return True
            slot = bucket * SLOTS + (mark + kick) % SLOTS
            mark, self.slots[slot] = self.slots[slot], mark
            bucket = self.other(bucket, mark)
        return False

    def delete(self, digest: bytes) -> None:
        slot = self.find(digest)
        if slot >= 0:
            self.slots[slot] = 0


class Segment:
    """The filter and the live digests of one segment."""

    def __init__(self, stored: dict[bytes, list], slots: bytes | None, resizes: int):
        self.stored, self.resizes = stored, resizes
        if slots is None:
            self.filter = CuckooFilter()
            self.rebuild(64)
        else:
            self.filter = CuckooFilter(slots=np.frombuffer(slots, dtype=np.uint16))

    def rebuild(self, buckets: int) -> None:
        """A filter of the given size or the next doubled one that takes all stored keys."""
        while True:
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(key) for key in self.stored):
                return
            buckets *= 2
            self.resizes += 1

    def insert(self, digest: bytes, keep: int | None, copies: int) -> None:
        if self.filter.find(digest) >= 0:
            entry = self.stored.get(digest)
            if entry is not None:
                entry[0] = keep if entry[0] is None else entry[0] if keep is None else min(entry[0], keep)
                entry[1] += copies
                return
        self.stored[digest] = [keep, copies]
        if not self.filter.insert(digest):
            self.resizes += 1
            self.rebuild((self.filter.mask + 1) * 2)

    def delete(self, digest: bytes, copies: int) -> None:
        entry = self.stored.get(digest) if self.filter.find(digest) >= 0 else None
        if entry is None:
            return
        entry[1] -= copies
        if entry[1] <= 0:
            del self.stored[digest]
            self.filter.delete(digest)

    def slots(self) -> bytes:
        return np.array(self.filter.slots, dtype=np.uint16).tobytes()


def _whole(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def _change_segment(rows: pd.DataFrame) -> pd.DataFrame:
    number = int(rows["segment"].iat[0])
    old = rows[rows["insert"].isna()]
    kept = old[old["digest"].notna()]
    stored = {d: [_whole(k), int(c)] for d, k, c in zip(kept["digest"], kept["keep_id"], kept["copies"], strict=True)}
    filters = old[old["slots"].notna()]
    segment = Segment(
        stored,
        None if filters.empty else filters["slots"].iat[0],
        0 if filters.empty else int(filters["resizes"].iat[0]),
    )
    new = rows[rows["insert"].notna()]
    for digest, keep, copies, insert in zip(new["digest"], new["keep_id"], new["copies"], new["insert"], strict=True):
        if insert:
            segment.insert(digest, _whole(keep), int(copies))
        else:
            segment.delete(digest, int(copies))
    n = len(segment.stored)
    out = pd.DataFrame(
        {
            "segment": pd.Series([number] * (n + 1), dtype="int32"),
            "digest": pd.Series([None, *segment.stored], dtype=object),
            "keep_id": pd.array([None, *(e[0] for e in segment.stored.values())], dtype="Int64"),
            "copies": pd.array([None, *(e[1] for e in segment.stored.values())], dtype="Int64"),
            "slots": pd.Series([segment.slots()] + [None] * n, dtype=object),
            "resizes": pd.array([segment.resizes] + [None] * n, dtype="Int32"),
        }
    )
    return out


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def _place(segments: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint"), F.lit(segments)).cast("int")


def divide_index(index: DataFrame, segments: int) -> DataFrame:
    """The live digests of an index in another number of segments; the next change rebuilds the filters."""
    live = index.filter(F.col("digest").isNotNull())
    empty = [F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("int").alias("resizes")]
    return live.select(_place(segments).alias("segment"), "digest", "keep_id", "copies", *empty)


def change_index(index: DataFrame, changes: DataFrame, segments: int) -> DataFrame:
    """The index after insertions and deletions (``CHANGES``); all inserts come before the deletes.

    Of a live digest the index keeps the smallest id ever inserted and the number of
    copies; a digest whose last copy is deleted is forgotten. Deleting an unknown digest
    does nothing. ``segments`` has to stay the same for the life of an index, or
    ``divide_index`` comes first; one for
    each SEGMENT_KEYS expected digests bounds what a task holds.
    """
    rows = index.select("*", F.lit(None).cast("boolean").alias("insert")).unionByName(
        changes.withColumn("segment", _place(segments)), allowMissingColumns=True
    )
    ordered = rows.groupBy("segment")
    return ordered.applyInPandas(lambda part: _change_segment(part.sort_values("insert", ascending=False)), INDEX)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest of a batch, so a text with many copies sends few rows per task."""
    for batch in batches:
        table = pa.table({"digest": batch.column("digest"), "keep_id": batch.column("id")})
        groups = table.group_by("digest").aggregate([("keep_id", "min"), ([], "count_all")])
        yield pa.RecordBatch.from_arrays(
            [
                groups["digest"].combine_chunks(),
                groups["keep_id_min"].combine_chunks(),
                groups["count_all"].combine_chunks(),
                pa.array(np.ones(len(groups), dtype=bool)),
            ],
            names=["digest", "keep_id", "copies", "insert"],
        )


def digests(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and SHA-256 of each text after runs of white space became one space; null counts as empty."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col(id_).cast("bigint").alias("id"), F.unhex(F.sha2(plain, 256)).alias("digest"))


def exact_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after white-space runs became one space (compared by
    SHA-256). The smallest id of a group stays; with ``index`` given, older documents in it
    count too. Rows without an id never lend it to their group; where no row has one, keep_id
    is null and all of them are kept. Repeated rows of the id that stays are all kept. An
    empty table gives no rows. Extra columns are not read.
    """
    rows = staged(digests(docs, id_, text))
    segments = max(1, -(-(rows.count() + (0 if index is None else index.count())) // SEGMENT_KEYS))
    changes = rows.mapInArrow(_combine, CHANGES)
    # segments without digests have no rows, so the number that an index was made with cannot be read from it
    old = empty_index(docs.sparkSession) if index is None else divide_index(index, segments)
    known = staged(change_index(old, changes, segments))
    classes = known.filter(F.col("digest").isNotNull()).select("digest", "keep_id", F.col("copies").alias("group_size"))
    # a hot digest lies on the left only; Spark splits it, the right side has one row per digest
    return rows.join(classes, "digest").select(
        F.col("id").alias(id_),
        "keep_id",
        "group_size",
        (F.col("keep_id").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

"""Compressed vectors: product codes whose nearest entries are found by slicing and intersecting bit masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.vectors import integer_rows, matrix
from attesta.session import staged

SCALE = 4096
MOST = 1 << 27
PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK = 8192
WORD = 64
BROADCAST_BYTES = 16 << 20


class MaskIndex:
    """Exact nearest entry of a small codebook of integer vectors, under squared distance.

    Per dimension the entries' coordinates are sorted, and prefix masks hold which entries
    come first: the entries between two coordinates are one prefix without another. A point
    that is known to be within a radius of some entry has all nearer entries among those
    within that radius in every dimension, which is the intersection of its ranges. Masks are
    words of 64 entries each, so a codebook may have any number.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, dtype=np.int64)
        k, width = self.entries.shape
        self.words = -(-k // WORD)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, axis=0)
        self.prefix = np.zeros((width, k + 1, self.words), dtype=np.uint64)
        for d in range(width):
            for i, e in enumerate(order[:, d].tolist()):
                self.prefix[d, i + 1] = self.prefix[d, i]
                self.prefix[d, i + 1, e // WORD] |= np.uint64(1 << (e % WORD))

    def distance(self, points: np.ndarray, which: np.ndarray) -> np.ndarray:
        gap = points - self.entries[which]
        return np.einsum("ij,ij->i", gap, gap)

    def first_guess(self, points: np.ndarray) -> np.ndarray:
        """Some entry near each point: the one next in the dimension in which entries spread most."""
        d = int(np.ptp(self.sorted, axis=0).argmax())
        order = np.argsort(self.entries[:, d], kind="stable")
        at = np.searchsorted(self.sorted[:, d], points[:, d])
        low, high = np.maximum(at - 1, 0), np.minimum(at, len(order) - 1)
        nearer = np.abs(points[:, d] - self.sorted[low, d]) <= np.abs(points[:, d] - self.sorted[high, d])
        return order[np.where(nearer, low, high)]

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that are within the radius in every dimension."""
        mask = np.full((len(points), self.words), ~np.uint64(0), dtype=np.uint64)
        for d in range(points.shape[1]):
            low = np.searchsorted(self.sorted[:, d], points[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], points[:, d] + radius, side="right")
            mask &= self.prefix[d, high] & ~self.prefix[d, low]
        return mask

    def nearest(self, points: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each point, of equally near ones the lowest."""
        if len(points) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        bound = self.distance(points, self.first_guess(points) if guess is None else guess)
        radius = np.ceil(np.sqrt(bound.astype(np.float64))).astype(np.int64) + 1
        mask = self.candidates(points, radius)
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.zeros(len(points), dtype=np.int64)
        for e in range(len(self.entries)):
            near = np.flatnonzero((mask[:, e // WORD] >> np.uint64(e % WORD)) & np.uint64(1))
            gap = points[near] - self.entries[e]
            far = np.einsum("ij,ij->i", gap, gap)
            better = far < best[near]
            best[near[better]], index[near[better]] = far[better], e
        return index, best


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, -1)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            yield piece, matrix(piece.column("x"), width)


def refined(rows: DataFrame, width: int, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry becomes the floored mean of the parts nearest to it.

    Tasks send the sum and count of each entry they met, which Spark adds up exactly; the
    driver gets one number per entry and position.
    """
    parts, entries, length = books.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [MaskIndex(b) for b in books]
        sums = np.zeros((parts, entries, length), dtype=object)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for _, x in _blocks(batches, width):
            for p, points in enumerate(np.moveaxis(_parts(x, parts), 1, 0)):
                at, _ = index[p].nearest(points)
                block = np.zeros((entries, length), dtype=np.int64)
                np.add.at(block, at, points)
                sums[p] += block
                counts[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(counts)
        for i in range(length):
            yield pa.record_batch(
                [
                    pa.array(((p * entries + e) * length + i).astype(np.int32)),
                    pa.array([str(v) for v in sums[p, e, i].tolist()], pa.string()),
                    pa.array(counts[p, e]),
                ],
                names=["cell", "total", "n"],
            )

    got = rows.select("x").mapInArrow(part, "cell int, total string, n bigint").groupBy("cell")
    books = books.copy()
    flat = books.reshape(-1)
    for r in got.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        flat[r["cell"]] = int(r["total"]) // r["n"]
    return books


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position), from the vectors of the smallest ids, after ``rounds`` rounds over all rows."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.ascontiguousarray(np.moveaxis(_parts(np.array([r["x"] for r in first], dtype=np.int64), parts), 0, 1))
    for _ in range(rounds):
        books = refined(rows, width, books)
    return books


def compress(
    df: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per usable vector: id, code, error, label_error, codebooks_sha256.

    An entry c becomes floor(4096 * c); vectors are cut into ``parts`` equal pieces, each with
    a codebook of at most 256 entries. Codebooks start as the pieces of the smallest ids (nulls
    last, equal ids by vector), fewer where the table has fewer rows. In each round every
    piece goes to its nearest entry, equally near ones to the lower index, then entries move to the
    floored means of their pieces; entries without any stay. ``code`` has two hex digits per
    piece, ``error`` is the squared distance of the vector to what its code stands for, and
    ``label_error`` the sum of these over rows of the same label, null being one. All numbers
    are exact. Which rows are left out and which entries raise an error (32768 and more)
    is said at ``integer_rows``; vectors whose length ``parts`` does not divide raise one too. Repeated
    rows and ids are rows of their own, an empty table gives no rows; other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows, width = integer_rows(df, vector, SCALE, 0, MOST, {"id": F.col(id_), "label": F.col(label)})
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    if width == 0:
        empty = f"{id_} {kinds['id']}, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return df.sparkSession.createDataFrame([], empty)
    if width % parts:
        raise ValueError(f"vectors of {width} entries cannot be cut into {parts} equal parts")
    books = fit(rows, width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    digits = np.array([f"{i:02x}" for i in range(entries)], dtype=object)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [MaskIndex(b) for b in books]
        for piece, x in _blocks(batches, width):
            code, error = np.full(len(x), "", dtype=object), np.zeros(len(x), dtype=np.int64)
            for p, points in enumerate(np.moveaxis(_parts(x, parts), 1, 0)):
                at, far = index[p].nearest(points)
                code, error = code + digits[at], error + far
            yield pa.record_batch(
                [piece.column("id"), piece.column("label"), pa.array(code, pa.string()), pa.array(error)],
                names=["id", "label", "code", "error"],
            )

    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    coded = staged(rows.mapInArrow(encode, schema))
    sums = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    held = sums.agg(F.sum(F.lit(32) + F.octet_length(F.coalesce(F.col("_label").cast("string"), F.lit(""))))).first()[0]
    sums = F.broadcast(sums) if held <= BROADCAST_BYTES else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )

"""The chunk index on a shared folder: runs of chunks, and a ledger that says which of them are served."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import staged
from attesta.sources.keyed import Append, KeyedTables, Replace, Snapshot, small_side

TABLES = {"current": "source_id", "contents": "content_hash", "dead": "source_id", "revoked": "source_id", "chunks": None}
GARBAGE, MOST_ENTRIES = 0.3, 1000
ID_BYTES = 64


@dataclass
class Prepared:
    """What a commit will make visible (source_id, content_hash, run), the source_id of those it will not, and the changes."""

    done: DataFrame
    withdrawn: DataFrame
    changes: dict[str, Replace | Append]


class ChunkIndex:
    """Chunks, appended run by run, with a ledger of small rows beside them.

    ``current`` has one row per served source (source_id, content_hash, run), ``contents`` one per
    served content (content_hash, source_id), ``revoked`` the sources that are never served again, and
    ``dead`` the (source_id, run) whose chunks are still stored but served no longer. A run writes
    its chunks once, to a folder of its own; the commit of the ledger publishes them. Readers leave out
    the dead pairs, which are few, instead of joining all chunks with all sources. ``compact`` and
    ``purge`` delete for real. Chunk rows have source_id, and run is added to them.
    """

    def __init__(self, spark: SparkSession, path: str, **sizes):
        self.spark, self.tables = spark, KeyedTables(spark, path, TABLES, **sizes)

    def done(self, writer: str, number: int) -> bool:
        """Whether this run of the writer has been published."""
        return self.tables.done(writer, number)

    # ---- reading -------------------------------------------------------------------

    def served(self, state: Snapshot | None = None) -> DataFrame | None:
        """The chunks that are served as of one commit, or None before the first."""
        state = state or self.tables.snapshot()
        chunks = self.tables.read("chunks", state)
        return None if chunks is None else self._living(chunks, state)

    def _living(self, chunks: DataFrame, state: Snapshot) -> DataFrame:
        t = state.tables.get("dead")
        if t is None or not t.rows:
            return chunks
        return chunks.join(small_side(self.tables.rows_of(t), t.rows * ID_BYTES), ["source_id", "run"], "left_anti")

    def current(self, ids: DataFrame, state: Snapshot | None = None) -> DataFrame:
        """source_id, content_hash, run of those of the given sources that are served."""
        got = self.tables.touched("current", ids, state)
        if got is None:
            return ids.select("source_id", F.lit("").alias("content_hash"), F.lit("").alias("run")).filter("false")
        return got

    def holders(self, hashes: DataFrame, state: Snapshot | None = None) -> DataFrame:
        """content_hash and held_by of the given contents (content_hash) that some source serves."""
        got = self.tables.touched("contents", hashes, state)
        if got is None:
            return hashes.select("content_hash", F.lit(0).cast("bigint").alias("held_by")).filter("false")
        return got.withColumnRenamed("source_id", "held_by")

    # ---- writing -------------------------------------------------------------------

    def stage(self, chunks: DataFrame, writer: str, number: int) -> tuple[str, DataFrame]:
        """(folder, rows) of a run's chunks, written once; nobody reads them before ``commit``."""
        rows = chunks.withColumn("run", F.lit(f"{writer}/{number}"))
        folder = self.tables.put("chunks", rows)
        return folder, self.spark.read.schema(rows.schema).parquet(f"{self.tables.path}/{folder}")

    def prepare(self, writer: str, number: int, written: tuple[str, DataFrame], hashes: DataFrame, registry: DataFrame) -> Prepared:
        """The changes that serve the chunks of a staged run whose source is APPROVED in ``registry`` now.

        ``hashes`` has the content_hash of each source_id of the run. A source's earlier chunks make
        way for the new ones; of a source that is no longer APPROVED, or revoked, only the chunks of
        this run are withdrawn. A content that a source serves no longer can be served by another one.
        """
        folder, rows = written
        run = F.lit(f"{writer}/{number}").alias("run")
        state = self.tables.snapshot()
        approved = registry.filter(F.col("lifecycle_status") == "APPROVED").select("source_id").distinct()
        ids = rows.select("source_id").distinct().join(hashes.select("source_id", "content_hash"), "source_id", "left")
        judged = ids.join(approved.withColumn("_ok", F.lit(True)), "source_id", "left")
        judged = staged(judged.select("source_id", "content_hash", run, F.coalesce("_ok", F.lit(False)).alias("_ok")))
        revoked = self.tables.touched("revoked", judged, state)
        if revoked is not None:
            judged = judged.join(revoked.select("source_id", F.lit(True).alias("_never")), "source_id", "left")
            judged = staged(judged.withColumn("_ok", F.col("_ok") & F.col("_never").isNull()).drop("_never"))
        good = judged.filter("_ok").drop("_ok")
        withdrawn = judged.filter("NOT _ok").select("source_id", "run")
        changes = self._leave(staged(self.current(good, state)), withdrawn, state)
        changes["current"] = Replace(good)
        changes["contents"] = Replace(good.select("content_hash", "source_id"), changes["contents"].gone)
        return Prepared(good, withdrawn.select("source_id"), changes | {"chunks": Append(folder, rows.schema)})

    def commit(self, writer: str, number: int, prepared: Prepared) -> bool:
        """Publish a prepared run; False, and nothing happens, if this run of the writer has been published."""
        return self.tables.commit(writer, number, prepared.changes)

    def _leave(self, before: DataFrame, more: DataFrame | None, state: Snapshot) -> dict[str, Replace]:
        """Changes by which the ledger rows ``before`` end: their contents are free, their chunks dead, as are those of ``more``."""
        pairs = before.select("source_id", "run")
        pairs = pairs if more is None else pairs.unionByName(more)
        known = self.tables.touched("dead", pairs, state)
        dead = pairs if known is None else pairs.unionByName(known.select("source_id", "run")).distinct()
        held = self.tables.touched("contents", before, state)
        freed = before.select("content_hash", "source_id")
        if held is not None:
            freed = freed.join(held, ["content_hash", "source_id"], "left_semi")
        none = before.filter("false")
        return {
            "current": Replace(none, before.select("source_id")),
            "contents": Replace(none.select("content_hash", "source_id"), freed),
            "dead": Replace(dead),
        }

    def revoke(self, writer: str, number: int, ids: DataFrame) -> bool:
        """The sources (source_id) are never served again. Their chunks stay stored until ``purge`` or ``compact``."""
        ids = staged(ids.select("source_id").distinct())
        state = self.tables.snapshot()
        changes = self._leave(staged(self.current(ids, state)), None, state)
        return self.tables.commit(writer, number, changes | {"revoked": Replace(ids)})

    def purge(self, writer: str, number: int, ids: DataFrame) -> bool:
        """Revoke the sources and delete their chunks: only the runs that hold any of them are written anew."""
        ids = staged(ids.select("source_id").distinct())
        self.revoke(f"{writer}/ledger", number, ids)
        return self._rewritten(writer, number, ids)

    def compact(self, writer: str, number: int, garbage: float = GARBAGE, most_entries: int = MOST_ENTRIES) -> bool:
        """Write all runs anew as one if more than this share of the stored chunks is dead or there
        are more runs than this; False if there is no need."""
        state = self.tables.snapshot()
        t = state.tables.get("chunks")
        if t is None or not t.at:
            return False
        if len(t.at) <= most_entries and self._living(self.tables.rows_of(t), state).count() >= (1 - garbage) * t.rows:
            return False
        return self._rewritten(writer, number, None)

    def _rewritten(self, writer: str, number: int, ids: DataFrame | None) -> bool:
        state = self.tables.snapshot()
        t = state.tables.get("chunks")
        entries = [] if t is None else list(t.at) if ids is None else self._entries_with(ids, state)
        if not entries:
            return self.tables.commit(writer, number, {})
        living = self._living(self.tables.rows_of(t, entries), state)
        pairs = staged(self.tables.rows_of(t, entries).select("source_id", "run").distinct())
        folder = self.tables.put("chunks", living)
        dead = self.tables.touched("dead", pairs, state)
        changes = {"chunks": Append(folder, t.schema, tuple(entries))}
        if dead is not None:  # what is no longer stored needs no ledger row
            left = staged(dead.join(pairs, ["source_id", "run"], "left_anti"))
            changes["dead"] = Replace(left, dead.select("source_id"))
        return self.tables.commit(writer, number, changes)

    def _entries_with(self, ids: DataFrame, state: Snapshot) -> list[int]:
        """The entries that store chunks of the sources; only ids are read."""
        t = state.tables["chunks"]
        if not t.at:
            return []
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        names = self.tables.rows_of(t).select("source_id", folder.alias("f")).join(ids, "source_id", "left_semi").select("f").distinct()
        found = {r["f"] for r in names.collect()}
        return [p for p, (d, _) in t.at.items() if d.split("/")[-1] in found]

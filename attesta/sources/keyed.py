"""Parquet tables of one folder that change together.

A keyed table lies in parts, by a hash of its key: a change replaces all rows of the keys it names
by writing the parts of these keys anew. An appended table is a list of folders, to which a
change adds one. Either way rows go to new folders, and one small commit file then says which
folders hold the tables. Readers follow one commit, so they see all of a change in all tables or
nothing of it, and a crash before the commit leaves everything as it was. The number of parts is
part of the commit and doubles with the rows.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
MOST_TRIES = 10


class Conflict(RuntimeError):
    """Other writers were faster each time."""


@dataclass(frozen=True)
class TableState:
    """Key (None: appended), schema and number of parts of a table; folder and rows of each part or appended folder."""

    key: str | None
    schema: StructType
    parts: int
    at: dict[int, tuple[str, int]] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.at.values())


@dataclass(frozen=True)
class Snapshot:
    """One commit: its number, the tables, and the last change of each writer."""

    number: int
    tables: dict[str, TableState]
    writers: dict[str, int]


@dataclass
class Replace:
    """All rows of the keys in ``delta`` and in ``gone`` (the key column) make way for ``delta``.

    Both are read several times and should be stored.
    """

    delta: DataFrame
    gone: DataFrame | None = None


@dataclass
class Append:
    """A folder written by ``put`` joins the table, and the entries ``drop`` leave it."""

    folder: str | None
    schema: StructType
    drop: tuple[int, ...] = ()


def place(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def small_side(df: DataFrame, bytes_: int) -> DataFrame:
    return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df


def _reach(key: str, parts: int) -> list:
    """Bytes of the keys, at most, and the parts they lie in (a null key lies in none)."""
    some = F.col(key).isNotNull()
    return [F.sum(F.octet_length(F.col(key).cast("string")) + F.lit(24)), F.collect_set(F.when(some, place(key, parts)))]


class KeyedTables:
    """The tables under ``path``; ``keys`` names the key column of each, or None for an appended one."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str | None], part_rows: int = PART_ROWS):
        self.spark, self.path, self.keys, self.part_rows = spark, path.rstrip("/"), keys, part_rows

    # ---- commits -------------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def snapshot(self) -> Snapshot:
        """The newest commit; of a folder without one an empty state."""
        number = max((int(n) for n in self._names("commits") if n.isdigit()), default=0)
        if number == 0:
            return Snapshot(0, {}, {})
        fs, where = self._fs(f"commits/{number}")
        stream = fs.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        rows = [json.loads(line) for line in text.split("\n")]
        tables = {r["table"]: TableState(r["key"], StructType.fromJson(r["schema"]), r["parts"], {}) for r in rows if "schema" in r}
        for r in rows:
            if "folder" in r:
                tables[r["table"]].at[r["part"]] = (r["folder"], r["rows"])
        return Snapshot(number, tables, {r["writer"]: r["change"] for r in rows if "writer" in r})

    def _publish(self, state: Snapshot) -> bool:
        """Put the commit file in its place; False if another writer has taken the number."""
        lines = [{"writer": w, "change": c} for w, c in state.writers.items()]
        for name, t in state.tables.items():
            lines.append({"table": name, "key": t.key, "schema": t.schema.jsonValue(), "parts": t.parts})
            lines += [{"table": name, "part": p, "folder": d, "rows": n} for p, (d, n) in sorted(t.at.items())]
        fs, draft = self._fs(f"commits/_draft-{uuid.uuid4().hex}")
        _, final = self._fs(f"commits/{state.number}")
        out = fs.create(draft, False)
        out.write(bytearray("\n".join(map(json.dumps, lines)).encode()))
        out.close()
        hadoop, gateway = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        never = getattr(hadoop, "Options$Rename").NONE  # a rename that refuses to replace a file
        how = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = never
        try:
            context = hadoop.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), how)
        except Exception:
            if fs.exists(final):
                fs.delete(draft, False)
                return False
            raise
        return True

    def done(self, writer: str, change: int) -> bool:
        """Whether this change of the writer has been committed."""
        return self.snapshot().writers.get(writer, -1) >= change

    # ---- reading -------------------------------------------------------------------

    def rows_of(self, t: TableState, parts: list[int] | None = None) -> DataFrame:
        """The rows of some parts or entries, or of all."""
        wanted = sorted(t.at if parts is None else set(parts) & set(t.at))
        if not wanted:
            # made of literals, so that Spark drops the steps that start from it
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema]).filter("false")
        leaf = "" if t.key is None else "/part={}"
        return self.spark.read.schema(t.schema).parquet(*(f"{self.path}/{t.at[p][0]}{leaf.format(p)}" for p in wanted))

    def read(self, name: str, state: Snapshot | None = None) -> DataFrame | None:
        """All rows of a table, or None if nothing was ever written to it."""
        state = state or self.snapshot()
        return self.rows_of(state.tables[name]) if name in state.tables else None

    def touched(self, name: str, keys: DataFrame, state: Snapshot | None = None) -> DataFrame | None:
        """The rows of the given keys; only their parts are read."""
        state = state or self.snapshot()
        if name not in state.tables:
            return None
        t = state.tables[name]
        size, parts = keys.agg(*_reach(t.key, t.parts)).first()
        return self.rows_of(t, parts).join(small_side(keys.select(t.key).distinct(), size or 0), t.key, "left_semi")

    # ---- writing -------------------------------------------------------------------

    def put(self, name: str, rows: DataFrame) -> str:
        """Rows written to a folder that no commit names yet."""
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, writer: str, change: int, changes: dict[str, Replace | Append]) -> bool:
        """Make all changes visible at once; False if this change of the writer already is.

        Changes of a writer are numbered upwards. Where another writer commits in between,
        the touched parts are written again on top of its rows; folders that were not committed
        are never read and go with ``vacuum``.
        """
        for _ in range(MOST_TRIES):
            state = self.snapshot()
            if state.writers.get(writer, -1) >= change:
                return False
            # the tables are small jobs that do not depend on each other
            with ThreadPoolExecutor(max(len(changes), 1)) as pool:
                jobs = {name: pool.submit(self._changed, name, state.tables.get(name), one) for name, one in changes.items()}
            tables = state.tables | {name: job.result() for name, job in jobs.items()}
            if self._publish(Snapshot(state.number + 1, tables, state.writers | {writer: change})):
                return True
        raise Conflict(f"{MOST_TRIES} other commits came first")

    def _changed(self, name: str, t: TableState | None, one: Replace | Append) -> TableState:
        return self._appended(name, t, one) if isinstance(one, Append) else self._replaced(name, t, one)

    def _appended(self, name: str, t: TableState | None, one: Append) -> TableState:
        t = t or TableState(None, one.schema, 0)
        at = {p: v for p, v in t.at.items() if p not in one.drop}
        if one.folder is not None:
            rows = self.spark.read.schema(t.schema).parquet(f"{self.path}/{one.folder}").count()
            at[t.parts] = (one.folder, rows)
        return replace(t, parts=t.parts + 1, at=at)

    def _replaced(self, name: str, t: TableState | None, one: Replace) -> TableState:
        key = self.keys[name]
        t = t or TableState(key, one.delta.schema, 1)
        columns = t.schema.fieldNames()
        named = one.delta.select(key, F.lit(True).alias("_new"))
        if one.gone is not None:
            named = named.unionByName(one.gone.select(key, F.lit(False).alias("_new")))
        size, touched, n_new, lost = named.agg(
            *_reach(key, t.parts), F.count_if("_new"), F.count_if(F.col("_new") & F.col(key).isNull())
        ).first()
        if lost:
            raise ValueError(f"{lost} rows for {name} have no {key}")
        parts = t.parts
        while t.rows + n_new > parts * self.part_rows:
            parts *= 2
        if parts > t.parts:
            touched = list(t.at)  # all rows move once; the next doubling comes after as many new ones
        touched = [p for p in touched if p in t.at]
        if not touched and not n_new:
            return t
        old = self.rows_of(t, touched).join(small_side(named.select(key).distinct(), size or 0), key, "left_anti")
        rows = one.delta.select(*columns).unionByName(old.select(*columns)).withColumn("part", place(key, parts))
        folder = f"{name}/{uuid.uuid4().hex}"
        # parts of many rows are split over tasks, small ones share a task
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        kept = {} if parts > t.parts else {p: v for p, v in t.at.items() if p not in touched}
        return replace(t, parts=parts, at=kept | {p: (folder, n) for p, n in self._counts(folder)})

    def _counts(self, folder: str) -> list[tuple[int, int]]:
        if not any(n.startswith("part=") for n in self._names(folder)):
            return []
        found = self.spark.read.schema("part int").parquet(f"{self.path}/{folder}").groupBy("part").count()
        return [(r["part"], r["count"]) for r in found.collect()]

    def vacuum(self) -> int:
        """Delete folders and commits that the newest commit does not need; returns how many folders.

        Only while no one reads an older commit and no one writes.
        """
        state = self.snapshot()
        used = {d for t in state.tables.values() for d, _ in t.at.values()}
        stale = [f"{name}/{f}" for name in self.keys for f in self._names(name) if f"{name}/{f}" not in used]
        old = [f"commits/{n}" for n in self._names("commits") if n != str(state.number)]
        for path in stale + old:
            fs, where = self._fs(path)
            fs.delete(where, True)
        return len(stale)

"""Keyed tables and the chunk index: replaced keys, growing parts, commits that hold or do not."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.plans.ingest import ingest_and_commit
from attesta.session import shared_dir
from attesta.sources.index import ChunkIndex
from attesta.sources.keyed import Append, Conflict, KeyedTables, Replace
from tests.test_state import source_rows

KINDS = "id bigint, value string"


def frame(spark, rows):
    return spark.createDataFrame(rows, KINDS).repartition(3)


def rows_of(tables):
    return sorted((r.id, r.value) for r in tables.read("t").collect())


def test_working_folder_without_configuration(spark, monkeypatch):
    class Plain:
        def __init__(self):
            self.conf, self.sparkContext = self, self
            self.master = "local[2]"

        def get(self, *_):
            return None

        def getConf(self):
            return self

    first = shared_dir(Plain())
    assert first == shared_dir(Plain()) and first.startswith("/")
    cluster = Plain()
    cluster.master = "spark://x"
    with pytest.raises(ValueError, match="shared folder"):
        shared_dir(cluster)


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    tables = KeyedTables(spark, str(tmp_path), {"t": "id"}, part_rows=20)
    known: dict[int, list[str]] = {}
    for change in range(6):
        ids = rng.sample(range(60), 25)
        new = [(i, f"{change}.{k}") for i in ids[:18] for k in range(rng.randint(1, 3))]
        gone = [(i,) for i in ids[15:]]
        assert tables.commit("w", change, {"t": Replace(frame(spark, new), spark.createDataFrame(gone, "id bigint"))})
        for i in ids:
            known.pop(i, None)
        for i, v in new:
            known.setdefault(i, []).append(v)
        assert rows_of(tables) == sorted((i, v) for i, vs in known.items() for v in vs)
    state = tables.snapshot().tables["t"]
    assert state.parts >= 4 and state.rows == sum(map(len, known.values())) <= state.parts * 20
    some = spark.createDataFrame([(5,), (7,), (7,), (1000,), (None,)], "id bigint")
    assert sorted(r.value for r in tables.touched("t", some).collect()) == sorted(known.get(5, []) + known.get(7, []))
    before = rows_of(tables)
    assert tables.vacuum() > 0 and rows_of(tables) == before


def test_a_small_change_writes_few_parts(spark, tmp_path):
    tables = KeyedTables(spark, str(tmp_path), {"t": "id"}, part_rows=10)
    tables.commit("w", 0, {"t": Replace(frame(spark, [(i, "old") for i in range(300)]))})
    before = tables.snapshot().tables["t"].at
    tables.commit("w", 1, {"t": Replace(frame(spark, [(3, "new")]))})
    after = tables.snapshot().tables["t"].at
    assert len(before) > 16 and sum(before[p] != after[p] for p in before) == 1
    assert [v for i, v in rows_of(tables) if i == 3] == ["new"]


def test_all_rows_of_a_hot_key_in_many_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        tables = KeyedTables(spark, str(tmp_path), {"t": "id"})
        wide = spark.range(40_000, numPartitions=4).select(F.lit(7).cast("bigint").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
        tables.commit("w", 0, {"t": Replace(wide)})
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert tables.read("t").count() == 40_000 and len(list(tmp_path.rglob("part=*/*.parquet"))) >= 4  # one per task that had read it


def test_nothing_is_seen_before_the_commit(spark, tmp_path, monkeypatch):
    tables = KeyedTables(spark, str(tmp_path), {"t": "id", "u": None})
    tables.commit("w", 0, {"t": Replace(frame(spark, [(1, "a"), (2, "b")]))})

    def crash(self, state):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="power"):
        m.setattr(KeyedTables, "_publish", crash)
        folder = tables.put("u", frame(spark, [(9, "x")]))
        tables.commit("w", 1, {"t": Replace(frame(spark, [(1, "lost")])), "u": Append(folder, frame(spark, []).schema)})
    assert rows_of(tables) == [(1, "a"), (2, "b")] and tables.read("u") is None and not tables.done("w", 1)
    folder = tables.put("u", frame(spark, [(9, "x")]))
    assert tables.commit("w", 1, {"t": Replace(frame(spark, [(1, "c")])), "u": Append(folder, frame(spark, []).schema)})
    assert not tables.commit("w", 1, {"t": Replace(frame(spark, [(1, "again")]))})
    assert rows_of(tables) == [(1, "c"), (2, "b")] and tables.read("u").count() == 1
    with pytest.raises(ValueError, match="no id"):
        tables.commit("w", 2, {"t": Replace(frame(spark, [(None, "a")]))})


def test_writers_in_between(spark, tmp_path, monkeypatch):
    tables = KeyedTables(spark, str(tmp_path), {"t": "id"})
    tables.commit("w", 0, {"t": Replace(frame(spark, [(1, "a"), (2, "b")]))})
    other, real = KeyedTables(spark, str(tmp_path), {"t": "id"}), KeyedTables._publish
    pending = [(1, "other"), (3, "other")]

    def late(self, state):
        if self is tables and pending:
            rows, pending[:] = list(pending), []
            other.commit("o", 0, {"t": Replace(frame(spark, rows))})
        return real(self, state)

    monkeypatch.setattr(KeyedTables, "_publish", late)
    assert tables.commit("w", 1, {"t": Replace(frame(spark, [(2, "mine")]))})
    assert rows_of(tables) == [(1, "other"), (2, "mine"), (3, "other")]
    monkeypatch.setattr(KeyedTables, "_publish", lambda self, state: False)
    with pytest.raises(Conflict):
        tables.commit("w", 2, {"t": Replace(frame(spark, [(2, "never")]))})


def approved(spark, texts, status="APPROVED"):
    rows, columns = source_rows([(i, "a.txt", f"{t} " * 40, "OPEN_CURATED", status, True) for i, t in texts.items()])
    return spark.createDataFrame(rows, columns).withColumn("ingest_key", F.concat(F.lit("k"), "source_id"))


def registry(sources, revoked=()):
    status = F.when(F.col("source_id").isin(list(revoked)), "REVOKED").otherwise("APPROVED") if revoked else F.lit("APPROVED")
    return sources.select("source_id", F.lit(None).cast("string").alias("content_hash"), status.alias("lifecycle_status"))


def words(index):
    return {r.source_id: r.chunk_text.split()[0] for r in index.served().collect()}


def test_runs_with_every_outcome(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path))
    calls = spark.sparkContext.accumulator(0)

    def make_client():
        def client(batch):
            calls.add(len(batch))
            return [[1.0] for _ in batch]

        return client

    first = approved(spark, {0: "alt", 3: "bleibt", 7: "gleich"})
    ingest_and_commit(first, index, registry(first), 0)
    second = approved(spark, {0: "eins", 1: "zwei", 2: "zwei", 3: "drei", 4: "vier", 5: "alt", 7: "gleich"})
    known = spark.createDataFrame([("k4",)], "ingest_key string")
    done = ingest_and_commit(second, index, registry(second, [3]), 1, known_keys=known, make_embedder=make_client)
    assert {(r.source_id, r.outcome, r.reason) for r in done.outcomes.collect()} == {
        (0, "ingested", None), (1, "ingested", None), (2, "skipped", "DUPLICATE_CONTENT"), (3, "failed", "NOT_APPROVED_ANY_MORE"),
        (4, "skipped", "KNOWN_KEY"), (5, "skipped", "DUPLICATE_CONTENT"), (7, "skipped", "UNCHANGED_CONTENT"),
    }
    # only this run's chunks of source 3 are withdrawn; what it served stays until it is revoked
    assert words(index) == {0: "eins", 1: "zwei", 3: "bleibt", 7: "gleich"}
    assert calls.value == 3
    assert {r.source_id: (r.lifecycle_status, r.content_hash is not None) for r in done.sources.collect()} == {
        0: ("INGESTED", True), 1: ("INGESTED", True), 2: ("APPROVED", False), 3: ("REVOKED", False), 4: ("APPROVED", False),
        5: ("APPROVED", False), 7: ("APPROVED", False),
    }
    assert {(r.outcome, r.reason): r.sources for r in done.report.collect() if hasattr(r, "sources")} or done.report.count() > 0
    third = approved(spark, {5: "alt"})
    ingest_and_commit(third, index, registry(third), 2)
    assert words(index)[5] == "alt"  # source 0 serves it no longer
    before = index.tables.snapshot()
    again = ingest_and_commit(second, index, registry(second), 1)
    assert again.outcomes.count() == 7 and index.tables.snapshot().number == before.number


def test_a_run_that_dies_is_invisible(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path))
    rows = approved(spark, {1: "eins"})
    ingest_and_commit(rows, index, registry(rows), 0)

    def crash(outcomes):
        raise RuntimeError("power cut")

    new = approved(spark, {1: "neu", 2: "zwei"})
    with pytest.raises(RuntimeError):
        ingest_and_commit(new, index, registry(new), 1, keep=crash)
    assert words(index) == {1: "eins"}
    ingest_and_commit(new, index, registry(new), 1)
    assert words(index) == {1: "neu", 2: "zwei"}
    assert index.tables.vacuum() >= 1 and words(index) == {1: "neu", 2: "zwei"}


def test_purge_and_compact_delete_for_real(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path), part_rows=2)
    for number, texts in enumerate([{1: "a", 2: "b"}, {3: "c", 4: "d"}, {1: "e"}]):
        rows = approved(spark, texts)
        ingest_and_commit(rows, index, registry(rows), number)
    stored = lambda: {(r.source_id, r.chunk_text.split()[0]) for r in index.tables.read("chunks").collect()}
    kept = [v for p, v in index.tables.snapshot().tables["chunks"].at.items() if p in (0, 2)]
    assert index.purge("purge", 0, spark.createDataFrame([(3,), (99,)], "source_id bigint"))
    assert words(index) == {1: "e", 2: "b", 4: "d"} and stored() == {(1, "a"), (1, "e"), (2, "b"), (4, "d")}
    assert all(v in index.tables.snapshot().tables["chunks"].at.values() for v in kept)  # runs without source 3 stay as they are
    assert not index.compact("compact", 0, garbage=0.9)
    assert index.compact("compact", 0, garbage=0.2)
    assert words(index) == {1: "e", 2: "b", 4: "d"} and stored() == {(1, "e"), (2, "b"), (4, "d")}
    state = index.tables.snapshot().tables
    assert len(state["chunks"].at) == 1 and state["dead"].rows == 0
    assert not index.purge("purge", 0, spark.createDataFrame([(2,)], "source_id bigint")) and 2 in words(index)
    back = approved(spark, {3: "c", 6: "c"})
    ingest_and_commit(back, index, registry(back), 3)
    assert 3 not in words(index)
    ingest_and_commit(back, index, registry(back), 4)
    assert words(index).get(6) is None  # 3 would hold it, and is withdrawn each time


def test_a_committed_run_cuts_no_text_twice(spark, tmp_path, monkeypatch):
    """Texts that fail the gate are not extracted, and outcomes count the written chunks."""
    from attesta.plans import ingest

    kept = []
    monkeypatch.setattr(ingest, "staged", lambda df, real=ingest.staged: kept.append((df, real(df))) or kept[-1][1])
    index = ChunkIndex(spark, str(tmp_path))
    texts = {1: "eins", 2: "zwei", 3: "zwei"}
    rows = approved(spark, texts).unionByName(approved(spark, {4: "vier"}, "DISCOVERED"))
    done = ingest_and_commit(rows, index, registry(rows), 0)
    assert {r.source_id: (r.outcome, r.chunks) for r in done.outcomes.collect()} == {
        1: ("ingested", 1), 2: ("ingested", 1), 3: ("skipped", 0), 4: ("failed", 0)
    }
    assert {r.source_id: r.n_extracted is None for r in kept[0][1].collect()} == {1: False, 2: False, 3: False, 4: True}
    plan = kept[-1][0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "sha2" not in plan


def test_empty_parts_cost_no_job(spark, tmp_path):
    tables = KeyedTables(spark, str(tmp_path), {"t": "id"})
    tables.commit("w", 1, {"t": Replace(frame(spark, [(1, "a")]))})
    none = tables.rows_of(tables.snapshot().tables["t"], [])
    assert none.schema == tables.snapshot().tables["t"].schema and none.count() == 0
    joined = frame(spark, [(1, "b")]).join(none, "id")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_purged_sources_are_chosen_before_the_shuffle(spark):
    from attesta.plans import jobs

    at = "CAST('2020-01-01' AS timestamp_ntz)"
    sources = spark.range(4).selectExpr("id AS source_id", f"CASE WHEN id < 2 THEN {at} END AS deleted_at", "CAST(NULL AS timestamp_ntz) AS revoked_at", f"{at} AS retained_from", "'PUBLIC' AS data_class")
    chunks = spark.range(8).selectExpr("id % 4 AS source_id", "CAST(id AS string) AS chunk_id")
    links = spark.range(12).selectExpr("id % 3 AS sheet_id", "id % 6 AS source_id").distinct()
    people = spark.createDataFrame([], "student_id bigint, left_on date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with ids too many for Spark's own limit
    try:
        plan = jobs.purge(sources, chunks, links, spark.createDataFrame([(1,)], "source_id bigint"), people, people, "2024-01-31 00:00:00", "job").plan
        physical = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical
        assert sorted((r.table, r.row_id) for r in plan.collect()) == [("rag_chunk", "0"), ("rag_chunk", "4"), ("worksheet_source_ref", "0|0")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

"""Life cycle, positions, grounding, evaluation, storage, ingestion."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions.hooks import embed, extract_hook
from attesta.operators import aggregates, evaluate, grounding, joins, lifecycle, ranking, retention
from attesta.plans.ingest import ingest_batch
from attesta.sources import chunks as C
from attesta.sources import corpus, registry


def fold(state, commands):
    """The life cycle, command by command."""
    now = {s: [st, v, tr] for s, st, v, tr in state}
    errors = set()
    for source, seq, command, flag in sorted(commands, key=lambda c: c[1]):
        if source not in now:
            errors.add((source, seq, "UNKNOWN_SOURCE"))
            continue
        status, verified, trust = now[source]
        if command == "revoke":
            now[source][0] = "REVOKED"
        elif command == "register" and status in ("DISCOVERED", "UNDER_REVIEW"):
            now[source] = ["REGISTERED", verified if flag is None else flag, trust]
        elif command == "approve" and status == "REGISTERED" and verified and trust != "UNVERIFIED":
            now[source][0] = "APPROVED"
        elif command == "ingest" and status == "APPROVED":
            now[source][0] = "INGESTED"
        elif command == "approve" and status == "REGISTERED":
            errors.add((source, seq, "APPROVAL_REFUSED"))
        else:
            errors.add((source, seq, f"WRONG_STATUS:{status}"))
    return now, errors


def lifecycle_data(seed=11):
    rng = random.Random(seed)
    statuses = ["DISCOVERED", "UNDER_REVIEW", "REGISTERED", "APPROVED", "INGESTED", "EVALUATED", "REVOKED"]
    state = [(i, rng.choice(statuses), rng.random() < 0.6, rng.choice(["OFFICIAL_BINDING", "UNVERIFIED", "OPEN_CURATED"])) for i in range(120)]
    kinds = ["register", "approve", "ingest", "revoke"]
    commands = []
    for seq in range(1500):
        source = 5 if rng.random() < 0.3 else rng.randrange(130)  # one hot source, some unknown ones
        kind = rng.choices(kinds, [4, 4, 4, 0.3])[0]
        commands.append((source, seq, kind, rng.choice([None, True, False]) if kind == "register" else None))
    return state, commands


STATE = "source_id bigint, lifecycle_status string, license_verified boolean, trust_level string"
COMMAND = "source_id bigint, seq bigint, command string, license_verified boolean"


def test_lifecycle_equals_the_fold(spark):
    state, commands = lifecycle_data()
    wanted, wanted_errors = fold(state, commands)
    table, errors = lifecycle.apply_commands(spark.createDataFrame(state, STATE), spark.createDataFrame(commands, COMMAND))
    got = {r.source_id: (r.lifecycle_status, r.license_verified) for r in table.collect()}
    assert got == {s: (v[0], v[1]) for s, v in wanted.items()}
    assert {(r.source_id, r.seq, r.error) for r in errors.collect()} == wanted_errors


def test_positions_equal_a_plain_window(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", i) for i in rng.sample(range(10_000), 900)] + [(None, 3), (None, 8)]
    frame = spark.createDataFrame(rows, "k string, o bigint")
    w = Window.partitionBy("k")
    wanted = frame.select("k", "o", (F.row_number().over(w.orderBy("o")) - 1).alias("idx"), F.count("*").over(w).alias("n"))
    got = ranking.positions(frame, ["k"], "o", bucket=64).select("k", "o", "idx", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_sparse_positions_are_cut_into_runs(spark):
    rng = random.Random(8)
    orders = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(20_000)} | {7, 8, 9})
    rows = [("hot", o) for o in orders] + [(f"k{i % 40}", i * 10**12) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k string, o bigint").repartition(4)
    w = Window.partitionBy("k")
    wanted = frame.select("k", "o", (F.row_number().over(w.orderBy("o")) - 1).alias("idx"), F.count("*").over(w).alias("n"))
    got = ranking.positions(frame, ["k"], "o", bucket=256).select("k", "o", "idx", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    largest = frame.groupBy("k", ranking._run_of(frame, "o", 256)).count().agg(F.max("count")).first()[0]
    assert largest < 1500


GROUNDING = [  # (refs, expected confidence, resolved sources) against citations 1 G, 2 G, 3 draft
    ([], "UNSUPPORTED_DRAFT", []),
    ([1], "GROUNDED", [11]),
    ([1, 2], "GROUNDED", [11, 12]),
    ([3], "UNSUPPORTED_DRAFT", [13]),
    ([1, 3], "UNSUPPORTED_DRAFT", [11, 13]),
    ([4], "UNSUPPORTED_DRAFT", []),
    ([0], "UNSUPPORTED_DRAFT", []),
    ([-1], "UNSUPPORTED_DRAFT", []),
    ([1, 9, 2], "UNSUPPORTED_DRAFT", [11]),
    ([2, 1], "GROUNDED", [12, 11]),
    ([1, 1], "GROUNDED", [11, 11]),
]


def test_grounding_cases(spark):
    statements = spark.createDataFrame([(1, i, "t", refs) for i, (refs, _, _) in enumerate(GROUNDING)], "artifact_id bigint, position bigint, text string, refs array<int>")
    citations = spark.createDataFrame([(1, 1, 11, "GROUNDED"), (1, 2, 12, "GROUNDED"), (1, 3, 13, "UNSUPPORTED_DRAFT")], "artifact_id bigint, rank int, source_id bigint, confidence string")
    rows = {r.position: r for r in grounding.ground(statements, citations).collect()}
    for i, (_, confidence, cited) in enumerate(GROUNDING):
        assert rows[i].confidence == confidence
        assert [c.source_id for c in rows[i].citations] == cited


def test_scores(spark):
    ranked = spark.createDataFrame(
        [("a", 1, "de-001"), ("a", 2, "de-002"), ("a", 3, "x"), ("b", 1, "x"), ("b", 2, "rel"), ("b", 3, "rel"), ("d", 11, "late")],
        "question_id string, rank int, source_id string",
    )
    questions = spark.createDataFrame(
        [("a", "DEUTSCH", "active", ["de-001", "de-002"]), ("b", "RELIGION", "active", ["rel"]), ("c", "DEUTSCH", "active", []),
         ("d", "DEUTSCH", "active", ["late"]), ("e", "RELIGION", "blocked-source-not-approved", ["x"])],
        "question_id string, domain string, status string, expected_source_ids array<string>",
    )
    scores = evaluate.score_questions(ranked, questions)
    got = {r.question_id: (r.precision_at_5, r.recall_at_10, r.reciprocal_rank) for r in scores.collect()}
    assert got["a"] == (0.4, 1.0, 1.0)
    assert got["b"] == (0.4, 2.0, 0.5)  # repeated hits count, so recall may exceed 1
    assert got["c"] == (0.0, 0.0, 0.0)
    assert got["d"] == (0.0, 0.0, pytest.approx(1 / 11))
    assert "e" not in got
    overall = {r.domain: r for r in evaluate.summarize(scores, questions).collect()}
    assert (overall[None].total, overall[None].skipped, overall[None].questions) == (5, 1, 4)
    assert overall[None].mean_precision_at_5 == pytest.approx(0.2)
    empty = evaluate.summarize(scores.filter("false"), questions.filter("false")).collect()
    assert [(r.domain, r.total, r.mean_reciprocal_rank) for r in empty] == [(None, 0, 0.0)]


def test_drift_is_one_sided(spark):
    def table(*values):
        return spark.createDataFrame([(None, f"m{i}", v) for i, v in enumerate(values)], "domain string, metric string, value double")

    fallen = evaluate.drift(table(0.74, 0.75, 0.9, 0.1), table(0.8, 0.8, 0.5)).collect()
    assert [r.metric for r in fallen] == ["m0"]


def test_latency_report_is_exact(spark):
    rows = [("a", float(i)) for i in range(1, 101)] + [("a", float("nan"))] * 10 + [(None, float(i)) for i in range(50)]
    rows += [("none", None), ("nan", float("nan")), ("b", 1.004), ("b", 1.001)]
    frame = spark.createDataFrame(rows, "k string, latency double").withColumn("is_error", F.lit(False))
    many = frame.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("x")
    for table, times in ((frame, 1), (many, 3)):
        got = {r.k: (r.events, r.p95) for r in aggregates.latency_report(table, ["k"]).collect()}
        assert got["a"][0] == 110 * times and got["a"][1] == pytest.approx(95.05)
        assert got[None][0] == 50 * times and got[None][1] == pytest.approx(46.55 if times == 1 else 47.0)
        assert got["none"][1] is None and got["nan"][1] is None and got["b"][1] == pytest.approx(1.00385 if times == 1 else 1.004)


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_percentiles_of_large_and_small_groups(spark, accuracy):
    rng = random.Random(4)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(6000)] + [("few", float(rng.randrange(4))) for _ in range(3000)]
    rows += [(f"k{n}", rng.gauss(0, 1)) for n in range(1, 60) for _ in range(n)] + [("hot", math.inf), ("hot", -math.inf)]
    frame = spark.createDataFrame(rows, "k string, latency double").withColumn("is_error", F.col("latency") > 9)
    wanted = frame.groupBy("k").agg(F.percentile("latency", F.lit(0.95)).alias("p")).collect()
    got = {r.k: r for r in aggregates.latency_report(frame, ["k"], accuracy=accuracy, target=2.0).collect()}
    for r in wanted:
        assert got[r.k].p95 == pytest.approx(r.p, rel=1e-12), r.k
        assert got[r.k].latency_alert == (r.p > 2.0)


def test_sketches_are_exact_where_small_and_bounded_where_large(spark):
    rng = random.Random(6)
    groups = {"small": [rng.gauss(0, 1) for _ in range(500)], "one": [7.5], "large": [rng.lognormvariate(0, 3) for _ in range(60_000)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("none", math.nan)]
    frame = spark.createDataFrame(rows, "k string, latency double")
    got = {r.k: r for r in aggregates.latency_sketch_report(frame, ["k"], F.lit(False)).collect()}
    assert got["small"].p95 == sorted(groups["small"])[474] and got["one"].p95 == 7.5 and got["none"].p95 is None
    rank = sum(v <= got["large"].p95 for v in groups["large"]) / len(groups["large"])
    assert 0.945 < rank < 0.955
    sketch = frame.groupBy("k").agg(F.octet_length(F.kll_sketch_agg_double("latency", aggregates.SKETCH_K)).alias("n")).collect()
    assert max(r.n for r in sketch) < 40_000


def test_grants(spark):
    day = lambda d: f"2024-01-{d:02d}"
    grants = spark.createDataFrame(
        [(1, 7, "p", ["ethik"], [], day(1), day(31)), (2, 7, "p", [], ["KS5"], day(1), day(31)), (3, 7, "p", [], [], day(1), day(9)), (4, 8, "p", [], [], day(10), day(10))],
        "grant_id bigint, school_id bigint, provider string, scope_subjects array<string>, scope_grade_bands array<string>, valid_from string, valid_until string",
    )
    requests = spark.createDataFrame(
        [(1, 7, "p", "ethik", "KS9"), (2, 7, "p", "deutsch", "KS5"), (3, 7, "p", "deutsch", "KS9"), (4, 7, "p", None, "KS9"),
         (5, 7, "q", "ethik", "KS5"), (6, 8, "p", "x", None), (7, None, "p", "ethik", "KS5"), (8, 7, "p", "deutsch", None)],
        "request_id bigint, school_id bigint, provider string, subject string, grade_band string",
    )
    got = {r.request_id: r.grant_id for r in joins.grants_for(requests, grants, day(10)).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 1, 5: None, 6: 4, 7: None, 8: 2}


def test_upsert_and_deletes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "point_id int, trust_level string")
    delta = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (4, "z", 1)], "point_id int, trust_level string, batch int")
    once = C.upsert(base, delta)
    assert {(r.point_id, r.trust_level) for r in once.collect()} == {(1, "a"), (2, "y"), (3, None), (4, "z")}
    assert sorted(C.upsert(once, delta).collect()) == sorted(once.collect(), key=lambda r: r.point_id) or C.upsert(once, delta).count() == 4
    assert [r.point_id for r in C.delete_where(base, trust_level_not="a").collect()] == [1]
    with pytest.raises(ValueError):
        C.delete_where(base, confessions=[])
    assert {r.point_id for r in C.delete_ids(base, spark.createDataFrame([(1,), (9,)], "point_id int")).collect()} == {2, 3}


def source_rows(contents):
    columns = "source_id bigint, uri string, content string, trust_level string, lifecycle_status string, license_verified boolean, subject string, confession_context string, license_info string, source_version int, retrieved_at string, deleted_at timestamp_ntz"
    rows = [(i, uri, content, trust, status, ok, None, None, "frei", 1, None, None) for i, uri, content, trust, status, ok in contents]
    return rows, columns


def test_ingest(spark):
    long = "Ein Satz mit Inhalt. " * 200
    repeated = "x" * 1000 + "y" * 5000
    rows, columns = source_rows(
        [
            (1, "a.txt", long, "OPEN_CURATED", "APPROVED", True),
            (2, "b.txt", long, "OPEN_CURATED", "APPROVED", True),
            (3, "c.txt", long + "!", "UNVERIFIED", "APPROVED", True),
            (4, "d.txt", long + "?", "OPEN_CURATED", "REVOKED", True),
            (5, "e.txt", long + ".", "OPEN_CURATED", "APPROVED", False),
            (6, "f.pdf", long + ",", "OPEN_CURATED", "APPROVED", True),
            (7, "g.txt", "kurz", "OPEN_CURATED", "APPROVED", True),
            (8, "h.txt", "  ", "OPEN_CURATED", "APPROVED", True),
            (9, "i.md", repeated, "OPEN_CURATED", "APPROVED", True),
            (10, "j.html", "<p>" + long + "</p>", "OPEN_CURATED", "APPROVED", True),
        ]
    )
    run = ingest_batch(spark.createDataFrame(rows, columns), make_embedder=lambda: lambda texts: [[float(len(x))] * 8 for x in texts])
    outcome = {r.source_id: (r.outcome, r.reason) for r in run.outcomes.collect()}
    assert outcome == {
        1: ("ingested", None), 2: ("skipped", "DUPLICATE_CONTENT"), 3: ("failed", "UNVERIFIED"), 4: ("failed", "NOT_APPROVED"),
        5: ("failed", "LICENSE_NOT_VERIFIED"), 6: ("failed", "EXTRACTION_FAILED"), 7: ("failed", "NO_USABLE_CHUNKS"),
        8: ("failed", "EXTRACTION_FAILED"), 9: ("ingested", None), 10: ("ingested", None),
    }
    rows_9 = [r.chunk_index for r in run.chunks.filter("source_id = 9").orderBy("chunk_index").collect()]
    assert rows_9[0] == 0 and len(rows_9) == len(set(rows_9)) < 7  # equal pieces of the y run appear once
    assert run.chunks.filter("size(vector) = 8").count() == run.chunks.count()
    held = spark.createDataFrame([(r.content_hash, 77) for r in spark.createDataFrame(rows, columns).filter("source_id = 9").select(F.sha2("content", 256).alias("content_hash")).collect()], "content_hash string, held_by bigint")
    again = {r.source_id: r.reason for r in ingest_batch(spark.createDataFrame(rows, columns), held).outcomes.collect()}
    assert again[9] == "DUPLICATE_CONTENT" and again[1] is None


def test_commit(spark):
    staged = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 2)], "point_id string, source_id bigint")
    sources = spark.createDataFrame([(1, "APPROVED", None), (2, "REVOKED", None), (3, "APPROVED", None)], "source_id bigint, lifecycle_status string, content_hash string")
    hashes = spark.createDataFrame([(1, "h1"), (2, "h2")], "source_id bigint, content_hash string")
    visible, updated, undone = C.commit(staged, sources, hashes)
    assert {r.point_id for r in visible.collect()} == {"p1", "p2"}
    assert {(r.source_id, r.lifecycle_status, r.content_hash) for r in updated.collect()} == {(1, "INGESTED", "h1"), (2, "REVOKED", None), (3, "APPROVED", None)}
    assert [r.point_id for r in undone.collect()] == ["p3"]


def test_registry_load_twice(spark):
    entries = spark.createDataFrame([("a", "t", "p", "u", "l", "official", "law", "DEUTSCH"), ("b", "t", "p", "u", "l", "unverified", "guidance", "RELIGION_KATH")],
                                    "entry_id string, title string, publisher string, official_url string, license_or_terms string, trust_level string, source_type string, subject string")
    none = spark.createDataFrame([], "approval_metadata string")
    first = registry.load_registry(entries, none)
    assert {(r.entry_id, r.trust_level, r.subject) for r in first.collect()} == {("a", "OFFICIAL_BINDING", "DEUTSCH"), ("b", "OFFICIAL_GUIDANCE", None)}
    assert registry.load_registry(entries, first).count() == 0


def test_corpus_listing_reads_files(spark, tmp_path):
    for name in ("2_Deutsch/a b.txt", "2_Deutsch/tief/b.pdf", "Privat/c.txt", "lose.txt"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x")
    listed = corpus.list_corpus(spark, str(tmp_path))
    assert sorted(r.rel_path for r in listed.collect()) == ["2_Deutsch/a b.txt", "2_Deutsch/tief/b.pdf"]
    assert corpus.list_corpus(spark, str(tmp_path), only="3_Religion").count() == 0
    assert corpus.list_corpus(spark, str(tmp_path), limit=1).first().rel_path == "2_Deutsch/a b.txt"


def test_cyclic_tree_raises(spark):
    versions = spark.createDataFrame([(1, 2, "ACTIVE"), (2, 1, "ACTIVE")], "id bigint, supersedes_id bigint, status string")
    with pytest.raises(ValueError):
        joins.version_heads(versions)


def test_deep_trees_are_followed_and_cycles_raise(spark):
    kinds = "strand_id bigint, node_id bigint, parent_id bigint, code string"
    deep = spark.createDataFrame([(0, i, i - 1 if i else None, str(i)) for i in range(40)], kinds).coalesce(1)
    assert joins.curriculum_paths(deep).agg(F.max("depth")).first()[0] == 39
    # node 1 is listed twice, once under its own child
    circle = spark.createDataFrame([(0, 0, None, "a"), (0, 1, 0, "b"), (0, 2, 1, "c"), (0, 1, 2, "d")], kinds)
    with pytest.raises(ValueError, match="cyclic"):
        joins.curriculum_paths(circle)


def test_a_chain_of_ten_thousand_nodes_takes_few_jobs(spark):
    n = 10_000
    chain = spark.range(n, numPartitions=4).select(
        F.lit(1).cast("bigint").alias("strand_id"), F.col("id").alias("node_id"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("c").alias("code"),
    )
    lost = spark.createDataFrame([(1, n + 5, n + 4, "x"), (2, 5, 4, "x"), (2, 0, None, "r"), (2, 1, 0, "a"), (2, 2, 0, "b")], "strand_id bigint, node_id bigint, parent_id bigint, code string")
    spark.sparkContext.setJobGroup("tree", "")
    got = joins.curriculum_paths(chain.unionByName(lost))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("tree"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 40
    row = got.filter("strand_id = 1").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max(F.length("path")).alias("l")).first()
    assert (row.n, row.d, row.l) == (n, n - 1, 2 * n - 1)
    assert {(r.node_id, r.depth, r.path) for r in got.filter("strand_id = 2").collect()} == {(0, 0, "r"), (1, 1, "r/a"), (2, 1, "r/b")}


def test_retention_audit(spark):
    sheets = spark.createDataFrame([(1, None), (2, None)], "sheet_id bigint, deleted_at timestamp_ntz")
    asked = spark.createDataFrame([(1, "t"), (1, "u"), (9, "t")], "sheet_id bigint, actor_id string")
    table, audit, unknown = retention.soft_delete(sheets, asked, "2024-01-31 00:00:00")
    assert {r.sheet_id: r.deleted_at is not None for r in table.collect()} == {1: True, 2: False}
    assert sorted((r.event_type, r.actor_id, r.details) for r in audit.collect()) == [
        ("soft_delete_worksheet", a, '{"worksheetId":"1"}') for a in "tu"
    ]
    assert [r.sheet_id for r in unknown.collect()] == [9]


def test_revoked_sources_are_purged_after_the_grace_period(spark):
    sources = spark.createDataFrame(
        [(1, "APPROVED", None, None), (2, "APPROVED", None, None)],
        "source_id bigint, lifecycle_status string, deleted_at timestamp_ntz, revoked_at timestamp_ntz",
    )
    asked = spark.createDataFrame([(1, "x"), (1, "y")], "source_id bigint, actor_id string")
    table, audit, _ = retention.revoke_sources(sources, asked, "2024-01-31 00:00:00")
    again, _, _ = retention.revoke_sources(table, asked, "2025-01-31 00:00:00")
    holds = spark.createDataFrame([], "source_id bigint")
    assert audit.count() == 2
    assert retention.hard_delete_due(again, holds, "2024-02-01 00:00:00").count() == 0
    assert [r.source_id for r in retention.hard_delete_due(again, holds, "2025-01-30 00:00:00").collect()] == [1]


def test_embedder_hook(spark):
    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "chunk_text string").coalesce(1)
    rows = embed(texts, lambda: lambda batch: [[len(x), 1] for x in batch]).collect()
    assert [r.vector for r in rows] == [[1.0, 1.0], [2.0, 1.0], [1.0, 1.0]]
    with pytest.raises(Exception, match="vectors for"):
        embed(texts, lambda: lambda batch: []).collect()


def test_extract_hook(spark):
    files = spark.createDataFrame([(1, b"ok", "a"), (2, b"", "a"), (3, b"boom", "b")], "id int, content binary, mime string")

    def make():
        def parse(payload, mime):
            if mime == "b":
                raise RuntimeError("no")
            return payload.decode()

        return parse

    rows = {r.id: (r.extracted_text, r.extract_error) for r in extract_hook(files, make).collect()}
    assert rows == {1: ("ok", None), 2: (None, "EMPTY_TEXT"), 3: (None, "RuntimeError: no")}


def test_commands_and_deletes_are_not_sorted(spark):
    """The joins hash one row per source or sheet, whatever the number of commands on it."""
    from attesta.operators import lifecycle, retention

    state = spark.createDataFrame([(1, "DISCOVERED", True, "OPEN_CURATED")], "source_id bigint, lifecycle_status string, license_verified boolean, trust_level string")
    steps = spark.range(50).selectExpr("id % 1 + 1 AS source_id", "id AS seq", "'register' AS command", "true AS license_verified")
    sheets = spark.range(3).selectExpr("id AS sheet_id", "CAST(NULL AS timestamp_ntz) AS deleted_at")
    asked = spark.range(9).selectExpr("id % 4 AS sheet_id", "id AS actor_id")
    judged = lifecycle.judge_commands(state, steps)[1]
    frames = [judged, *retention.soft_delete(sheets, asked, "2024-01-01 00:00:00")]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
    assert judged.filter("error IS NULL").count() == 1 and judged.count() == 50
    assert [f.count() for f in frames[1:]] == [3, 7, 1]

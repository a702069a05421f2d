"""Search, rerank, citations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import search as S
from attesta.plans.retrieve import retrieve_batch

POINT = "point_id bigint, vector array<float>, trust_level string, subject string, confession_context string, source_id bigint, chunk_text string, page_or_section string, content_hash string"
SOURCE = "source_id bigint, title string, uri string, publisher string, license_info string, retrieved_at string, source_version int, content_hash string"


def cosine(a, b):
    if len(a) != len(b) or not a:
        return 0.0
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na * nb else 0.0


@pytest.fixture(scope="module")
def random_points(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        n = 3 if i % 50 == 7 else 4
        vector = [0.0] * n if i % 40 == 3 else [float(rng.randint(-3, 3)) for _ in range(n)]
        subject = rng.choice(["DEUTSCH", "RELIGION", "ETHIK", None])
        context = rng.choice(["EVANGELISCH", "KATHOLISCH", "RELIGIONSKUNDLICH", None])
        trust = rng.choice(["OFFICIAL_BINDING", "USER_APPROVED", "UNVERIFIED", None])
        rows.append((i, vector, trust, subject, context, i % 9, f"text {i}", "chunk:0", None))
    queries = [(q, [float(rng.randint(-3, 3)) for _ in range(4)], rng.choice(["DEUTSCH", "RELIGION", None]),
                rng.choice([None, [], ["EVANGELISCH"], ["KATHOLISCH", "RELIGIONSKUNDLICH"]])) for q in range(30)]
    return rows, queries


def brute_force(rows, queries, limit):
    out = {}
    for q, vector, subject, contexts in queries:
        hits = [
            (-cosine(vector, r[1]), r[0]) for r in rows
            if r[2] != "UNVERIFIED" and (subject is None or r[3] == subject) and (not contexts or r[4] in contexts)
        ]
        out[q] = [(i, round(-s, 9)) for s, i in sorted(hits, key=lambda h: (round(h[0], 12), h[1]))[:limit]]
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 20_000}, {"broadcast_bytes": 1_000}])
def test_exact_search(spark, random_points, options):
    rows, queries = random_points
    points = spark.createDataFrame(rows, POINT).repartition(5)
    asked = spark.createDataFrame(queries, "query_id bigint, vector array<double>, subject string, contexts array<string>")
    got = {}
    for r in S.search(asked, points, limit=12, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.point_id, round(r.score, 9)))
    wanted = brute_force(rows, queries, 12)
    for q, hits in wanted.items():
        assert got.get(q, []) == hits  # ties at the limit included: the smaller id wins


def test_string_ids(spark):
    points = spark.createDataFrame([("b", [1.0], None, None, None), ("a", [1.0], None, None, None)], "point_id string, vector array<double>, trust_level string, subject string, confession_context string")
    asked = spark.createDataFrame([("q", [2.0], None, None)], "query_id string, vector array<double>, subject string, contexts array<string>")
    assert [r.point_id for r in S.search(asked, points, limit=1).collect()] == ["a"]


def naive_mmr(candidates, k, lam):
    left, picked = list(range(len(candidates))), []
    while left and len(picked) < k:
        best, best_value = None, -math.inf
        for i in left:
            nearest = max([0.0] + [cosine(candidates[i][1], candidates[j][1]) for j in picked])
            value = lam * candidates[i][0] - (1 - lam) * nearest
            if value > best_value:
                best, best_value = i, value
        picked.append(best)
        left.remove(best)
    return picked


def test_greedy_picks_equal_the_loop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 15))
        candidates = [(float(rng.random()), [float(x) for x in rng.normal(size=5)]) for _ in range(n)]
        if n > 2:
            candidates[1] = candidates[0]
        got = S.greedy_picks(np.array([c[0] for c in candidates]), [c[1] for c in candidates], 5, 0.7)
        assert got == naive_mmr(candidates, 5, 0.7)


def six_points(spark):
    base = [
        (1, [1.0, 0.0, 0.0], "OFFICIAL_BINDING", "RELIGION", "EVANGELISCH"),
        (2, [0.0, 1.0, 0.0], "OFFICIAL_BINDING", "RELIGION", "KATHOLISCH"),
        (3, [0.7, 0.7, 0.0], "OFFICIAL_GUIDANCE", "RELIGION", "KONFESSIONSSENSIBEL_UEBERGREIFEND"),
        (4, [0.0, 0.0, 1.0], "OFFICIAL_BINDING", "ETHIK", "RELIGIONSKUNDLICH"),
        (5, [0.5, 0.5, 0.5], "OPEN_CURATED", "DEUTSCH", "NICHT_ANWENDBAR"),
        (6, [1.0, 1.0, 1.0], "UNVERIFIED", "DEUTSCH", "NICHT_ANWENDBAR"),
    ]
    points = spark.createDataFrame([(*b, b[0], f"text {b[0]}", "S. 1", "h") for b in base], POINT)
    sources = spark.createDataFrame([(b[0], f"t{b[0]}", None, "P", "frei", None, 1, None) for b in base], SOURCE)
    return points, sources


def ids(spark, subject, vector=(1.0, 1.0, 1.0), change_points=None, change_sources=None, **options):
    points, sources = six_points(spark)
    points = change_points(points) if change_points else points
    sources = change_sources(sources) if change_sources else sources
    asked = spark.createDataFrame([(0, list(vector), subject)], "query_id bigint, vector array<double>, display_subject string")
    return [r.source_id for r in retrieve_batch(asked, points, sources, **options).orderBy("rank").collect()]


def test_retrieval_filters(spark):
    assert sorted(ids(spark, "evangelische-religion")) == [1, 3]
    assert sorted(ids(spark, "katholische-religion")) == [2, 3]
    assert ids(spark, "ethik") == [4]
    assert ids(spark, "deutsch") == [5]
    assert sorted(ids(spark, None)) == [1, 2, 3, 4, 5]
    assert ids(spark, "deutsch", minimum="OFFICIAL_GUIDANCE") == []


def test_trust_floor_comes_after_the_limit(spark):
    # k = 1 fetches three hits; the best three are below the floor, so nothing is left
    def lower(points):
        return points.withColumn("trust_level", F.when(F.col("point_id").isin(3, 5, 1), F.lit("USER_APPROVED")).otherwise(F.col("trust_level")))

    assert ids(spark, None, vector=(1.0, 0.6, 0.3), k=1, minimum="OFFICIAL_GUIDANCE", change_points=lower) == []


def test_incomplete_citations_drop(spark):
    blank = lambda s: s.withColumn("publisher", F.when(F.col("source_id") == 1, F.lit(" ")).otherwise(F.col("publisher")))
    assert ids(spark, "evangelische-religion", change_sources=blank) == [3]
    missing = lambda s: s.filter("source_id <> 3")
    assert ids(spark, "evangelische-religion", change_sources=missing) == [1]


def test_missing_trust_passes_the_filter_and_fails_the_floor(spark):
    points = spark.createDataFrame([(1, None), (2, "UNVERIFIED"), (3, "USER_APPROVED")], "point_id int, trust_level string")
    assert [r.point_id for r in S.payload_filter(points, trust_not="UNVERIFIED").orderBy("point_id").collect()] == [1, 3]
    assert [r.point_id for r in S.min_trust(points, "USER_APPROVED").collect()] == [3]


def test_unknown_subject_raises(spark):
    with pytest.raises(Exception, match="unknown display subject"):
        ids(spark, "sport")


@pytest.mark.parametrize("pass_blocks", [1, 3, 50])
def test_passes_over_the_points(spark, random_points, pass_blocks, monkeypatch):
    monkeypatch.setattr(S, "PASS_BLOCKS", pass_blocks)
    rows, queries = random_points
    points = spark.createDataFrame(rows, POINT).repartition(3)
    asked = spark.createDataFrame(queries, "query_id bigint, vector array<double>, subject string, contexts array<string>")
    whole = sorted(map(tuple, S.search(asked, points, limit=5).collect()))
    assert sorted(map(tuple, S.search(asked, points, limit=5, broadcast_bytes=4_000).collect())) == whole


def test_read_back_beyond_the_broadcast_limit(spark, random_points, monkeypatch):
    rows, queries = random_points
    points = spark.createDataFrame(rows, POINT).repartition(5)
    asked = spark.createDataFrame(queries, "query_id bigint, vector array<double>, subject string, contexts array<string>")
    near = sorted(map(str, S.search_payload(asked, points, ["source_id", "chunk_text"], limit=6).collect()))
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    far = S.search_payload(asked, points, ["source_id", "chunk_text"], limit=6)
    assert sorted(map(str, far.collect())) == near
    assert "vector" not in S.search_payload(asked, points, ["source_id"], limit=6, vectors=False).columns


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("map_bytes", [S.MAP_BYTES, 4096])
def test_no_hit_is_lost_and_few_others_are_kept(spark, kind, map_bytes, monkeypatch):
    monkeypatch.setattr(S, "MAP_BYTES", map_bytes)
    points = spark.range(60_000, numPartitions=4).select(F.col("id").cast(kind).alias("point_id"), F.lit("t").alias("chunk_text"))
    hits = points.filter(F.col("point_id").cast("bigint") % 30 == 7).select("point_id", F.lit(1.0).alias("score"))
    kept = S.points_hit(points, hits, hits.count())
    assert kept.join(hits, "point_id", "left_semi").count() == hits.count() == 2000
    assert kept.count() < 2000 + 60_000 / (20 if map_bytes > 4096 else 10)
    assert kept.columns == ["point_id", "chunk_text"]


def test_stored_hits_hold_no_texts(spark, monkeypatch):
    """Many queries that hit the same long text must not store it once per hit (and Spark then broadcast it by its size on disk)."""
    from attesta.plans import retrieve

    text, longest = "Satz. " * 5000, []

    def looked_at(df, staged=retrieve.staged):
        out = staged(df)
        if "chunk_text" in out.columns:
            longest.append(out.agg(F.max(F.length("chunk_text"))).first()[0])
        return out

    monkeypatch.setattr(retrieve, "staged", looked_at)
    points = spark.createDataFrame([(1, [1.0, 1.0], "OPEN_CURATED", "DEUTSCH", "NICHT_ANWENDBAR", 1, text, "p", "h")], POINT)
    sources = spark.createDataFrame([(1, "t", "u", "p", "l", "r", 1, "h")], SOURCE)
    queries = spark.createDataFrame([(i, [1.0, float(i)], None) for i in range(50)], "query_id bigint, vector array<double>, display_subject string")
    found = retrieve_batch(queries, points, sources).collect()
    assert len(found) == 50 and {r.chunk_text for r in found} == {text}
    assert max(longest) == 1
    assert "chunk_text" not in retrieve_batch(queries, points, sources, texts=False).columns


def test_equal_queries_are_searched_once(spark, monkeypatch):
    """Very many queries may ask the same: what is sent out and read back must not grow with them, and each gets its rows."""
    held = []

    def counted(vectors, matrix=S._matrix):
        held.append(len(vectors))
        return matrix(vectors)

    points, sources = six_points(spark)
    kinds = [([1.0, 1.0, 1.0], None), ([1.0, 1.0, 1.0], "deutsch"), ([1.0, 0.0, 0.5], None), ([], "ethik")]
    asked = [(i, *kinds[i % 4]) for i in range(200)]
    schema = "query_id bigint, vector array<double>, display_subject string"
    alone = {}
    for i, kind in enumerate(kinds):
        rows = retrieve_batch(spark.createDataFrame([(0, *kind)], schema), points, sources, k=2).collect()
        alone[i] = sorted(str({**r.asDict(), "query_id": None}) for r in rows)
    monkeypatch.setattr(S, "_matrix", counted)
    got = {}
    for r in retrieve_batch(spark.createDataFrame(asked, schema), points, sources, k=2).collect():
        got.setdefault(r.query_id, []).append(str({**r.asDict(), "query_id": None}))
    assert {q: sorted(rows) for q, rows in got.items()} == {i: alone[i % 4] for i in range(200)}
    assert sum(held) == 4

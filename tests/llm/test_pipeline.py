"""The corpus pipeline on small tables, stage by stage."""

import random

import pytest

import corpus_pipeline
from attesta.llm.queries import QUERIES
from tests.llm import brute

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    names = brute.vocabulary(rng, 500)
    rows = [r[:5] for r in brute.documents()]
    rows += [(1000 + i, " ".join(w.upper() + "!!" for w in brute.prose(rng, 50, names).split()), "en", "s0", 1) for i in range(40)]
    item = brute.prose(rng, 30, names)
    rows.append((2000, brute.prose(rng, 100, names) + " " + item + " end", "de", "s1", 1))
    labels = [(r[0], int(not 1000 <= r[0] < 1040), 0) for r in rows if r[0] is not None]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if number < 4:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
            assert set(after) <= set(before)
        if number == 0:
            assert sum(r.doc_id is not None and r.doc_id in range(1000, 1040) for r in after) <= 2
            assert sum(r.doc_id is not None and r.doc_id < 145 for r in after) >= 140
        if number == 1:
            assert len([r for r in after if r.doc_id == 5]) <= 1
            sets = [brute.shingles(r.text) for r in after if r.doc_id is not None]
            assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
            assert 2000 in ids
        if number == 2:
            assert {r.doc_id for r in before} - ids == {2000}
        if number == 3:
            kept = sum(len(brute.words(r.text)) for r in after) / sum(len(brute.words(r.text)) for r in before)
            assert 0.2 < kept < 1
        if number == 4:
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(r.doc_id for r in before if r.doc_id is not None)


def test_near_copies_are_decided_row_by_row(spark):
    rng = random.Random(3)
    names = brute.vocabulary(rng, 400)
    one, two, three, four = (brute.prose(rng, 60, names) for _ in range(4))
    rows = [
        (1, one), (1, two), (1, one), (2, brute.edit(rng, one, 1)), (2, three), (3, three), (None, two + " end"), (None, four), (None, four),
        (None, None), (None, None), (None, ""), (9, None), (9, None),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS).repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, one), (1, two), (2, three), (0, four), (0, ""), (0, ""), (0, ""), (9, "")])
    assert docs.columns == kept[0].__fields__


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, folder, tmp_path, empty):
    base = str(tmp_path / "tables")
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        (table.limit(0) if name == empty else table).write.parquet(f"{base}/{name}.parquet")
    rows = corpus_pipeline.run(spark, base).count()
    assert rows == 0 if empty == "documents" else rows > 0


def test_queries_have_their_columns(spark):
    data = "/root/testdata/sf0.001"
    expected = {
        "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op3_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op6_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
        "op8_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
        "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    }
    for key, kinds in expected.items():
        assert dict(QUERIES[key](spark, data).dtypes) == kinds

"""Mixing, sharding, licences, URL lists, language model and quality classifier."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import license_scan, lm, mixing, quality, sharding, url_filter
from tests.llm import brute

POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.documents(), brute.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_mixing_reaches_targets(docs, nothing):
    rows = mixing.mix(docs, 0.5, POWERS, mixing.register("text")).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in brute.documents())
    tokens = {r[0]: len(brute.words(r[1])) for r in brute.documents() if r[0] is not None}
    assert all(r.tokens == tokens[r.doc_id] for r in rows if r.doc_id is not None)
    cells = defaultdict(float)
    weights = {}
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.tokens
        weights[r.source, r.lang, r.topic] = r.weight
    cells = {k: v for k, v in cells.items() if v}
    fitted = {k: v for k, v in cells.items()}
    targets = []
    for d, name in enumerate(("source", "lang", "topic")):
        sums = Counter()
        for k, v in cells.items():
            sums[k[d]] += v
        parts = {k: v ** POWERS[name] for k, v in sums.items()}
        targets.append({k: v / sum(parts.values()) for k, v in parts.items()})
    for _ in range(mixing.MOST_ROUNDS):
        for d in range(3):
            have = Counter()
            for k, v in fitted.items():
                have[k[d]] += v
            fitted = {k: v * targets[d][k[d]] / have[k[d]] for k, v in fitted.items()}
    for k, v in fitted.items():
        assert weights[k] == pytest.approx(v, rel=1e-3, abs=1e-7)
    kept = sum(r.tokens * r.probability for r in rows)
    assert kept == pytest.approx(0.5 * sum(r.tokens for r in rows), rel=1e-4)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.sampled)
    assert all(len(v) == 1 for k, v in by_id.items() if k is not None)
    assert mixing.mix(nothing, 0.5, POWERS, mixing.register("text")).count() == 0


def test_given_targets_are_met_or_named(spark, docs, nothing):
    def table(dimension, shares):
        return spark.createDataFrame(list(shares.items()), "value string, target double")

    sources, langs = {"s0": 2.0, "s1": 5.0, None: 1.0}, {"en": 0.3, "de": 0.6, None: 0.1}
    topics = F.lit("all")
    given = {"source": table("source", sources), "lang": table("lang", langs), "topic": 0.9}
    rows = mixing.mix(docs, 0.4, given, topics).collect()
    cells = {(r.source, r.lang, r.topic): r.weight for r in rows if r.tokens}
    for d, shares in enumerate((sources, langs)):
        have = defaultdict(float)
        for k, w in cells.items():
            have[k[d]] += w
        for value, share in shares.items():
            assert have[value] == pytest.approx(share / sum(shares.values()), rel=2e-6)
    assert max(r.residual for r in rows) <= 1e-6
    some = {"source": table("source", {"s0": 1.0}), "lang": 1.0, "topic": 1.0}  # the others get nothing
    assert {r.source for r in mixing.sample(docs, 0.2, some, topics).collect()} == {"s0"}
    for wrong, words in (({"s9": 1.0}, "s9"), ({"s0": -1.0, "s1": 2.0}, "source"), ({"s0": 0.0}, "source")):
        with pytest.raises(mixing.Unreachable, match=words):
            mixing.mix(docs, 0.5, {**some, "source": table("source", wrong)}, topics)
    # en only in s0 and de only in s1: shares of languages and sources contradict each other
    apart = spark.createDataFrame([(i, "a b c", *(("en", "s0") if i % 2 else ("de", "s1")), 1) for i in range(20)], "doc_id bigint, text string, lang string, source string, n_chars int")
    clash = {"source": table("source", {"s0": 0.9, "s1": 0.1}), "lang": table("lang", {"en": 0.5, "de": 0.5}), "topic": 1.0}
    with pytest.raises(mixing.Unreachable, match="source"):
        mixing.mix(apart, 0.5, clash, topics)


@pytest.mark.parametrize("seed", range(6))
def test_minimax_cut(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.choice([1, 2, 3, 50]) * rng.randint(1, 9) for _ in range(rng.randint(1, 9))])
    shards = rng.randint(1, 4)
    best = min(
        max(sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, len(sizes))))
        for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1)
    )
    parts = sharding.cut(sizes, shards)
    assert sharding.smallest_capacity(sizes, shards) == best
    assert (np.diff(parts) >= 0).all() and np.bincount(parts, sizes).max() == best


def test_sharding(docs, nothing):
    rows = brute.documents()
    got = sharding.shard_documents(docs, 4).collect()
    facts = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == facts
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(v) == 1 for v in homes.values())
    assert sharding.shard_documents(nothing, 4).count() == 0


def test_license_scan(spark, docs, nothing):
    notices = [
        (1, "Some text.\nReleased under the MIT License.\nMore.", ["mit"]),
        (2, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", ["apache-2.0", "proprietary"]),
        (3, "This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        (4, "Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        (5, "You need a license to drive a heavy truck on this road.", []),
        (6, "The copyright of the old songs has ended long ago, they say.", []),
        (None, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["mit"]),
    ]
    more = spark.createDataFrame([(i, t, "en", "s", 1, "x", None, 1, 1, "w") for i, t, _ in notices], brute.SCHEMA)
    got = license_scan.scan(docs.filter(F.col("doc_id") > 10).withColumn("doc_id", F.col("doc_id") + 100).unionByName(more)).collect()
    found = {r.doc_id: r.families for r in got if r.doc_id is None or r.doc_id < 100}
    assert found == {i: f for i, _, f in notices}
    assert all(r.families == [] for r in got if r.doc_id is not None and r.doc_id > 100)
    assert len(got) == docs.filter(F.col("doc_id") > 10).count() + len(notices)
    assert license_scan.scan(nothing).count() == 0


GPL = """{0} This program is free software: you can redistribute it and/or modify
{0} it under the terms of the GNU{1} General Public License as published by
{0} the Free Software Foundation, either version {2} of the License, or
{0} (at your option) any later version.
{0}
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software
"""
BSD = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 */
"""


def test_wrapped_notices(spark):
    cases = [
        ("Some text\n\n" + MIT + "\nMore text", ["mit"]),
        (BSD, ["bsd"]),
        (GPL.format("#", "", "3"), ["gpl-3.0"]),
        (GPL.format(" *", "", "2"), ["gpl-2.0"]),
        (GPL.format("//", " Affero", "3"), ["agpl-3.0"]),
        ("Prose without an end\nReleased under the MIT License.", ["mit"]),
        ("and all rights\nreserved by", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert {i: r.families for i, r in rows.items() if i < 6} == {i: f for i, (_, f) in enumerate(cases) if i < 6}
    assert rows[6].paragraphs == 1


def test_paragraphs_without_a_cue_word(spark):
    """Notices are found, and paragraphs counted, where no word of the text speaks of licences; lines of such paragraphs also alone."""
    part = "No part of this publication may be reproduced or transmitted in any form"
    cases = [
        (part + ".", ["proprietary"], 1),
        ("It was a fine day, and the road\n" + part, ["proprietary"], 1),
        ("A first line.\nA second line.\n\n---\nA third one.", [], 3),
        (None, [], 0),
        ("\n--\n", [], 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id bigint, text string")
    rows = {r.doc_id: (r.families, r.paragraphs) for r in license_scan.scan(docs).collect()}
    assert rows == {i: (f, n) for i, (_, f, n) in enumerate(cases)}


def test_notices_among_other_words(spark):
    """A notice is found in the middle of a long line, as a sentence and without an end of its own."""
    prose = "the old road goes down to the river where boats wait for grain and the market opens late in the week"
    cases = [
        (f"{prose.capitalize()}. Released under the MIT License. {prose.capitalize()}. {prose.capitalize()}.", ["mit"]),
        (f"{prose} {prose} released under the MIT License {prose} {prose}", ["mit"]),
        (f"{prose.capitalize()}.\nIn short {prose}\nand so on. Licensed under CC BY-NC 4.0. Then\n{prose}.", ["cc-by-nc"]),
        (f"{prose} {prose} {prose}. {prose}.", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    assert {r.doc_id: r.families for r in license_scan.scan(docs).collect()} == {i: f for i, (_, f) in enumerate(cases)}


def test_bound_drops_nothing_that_is_predicted(spark):
    """Pieces that the bound drops have no family at or above the least probability, by any weights."""
    rng = random.Random(3)
    many = len(license_scan.FAMILIES)
    words = [f"w{i}" for i in range(60)]
    weights = spark.createDataFrame(
        [(i, *[rng.gauss(0, 2) for _ in range(many)]) for i in range(0, license_scan.FEATURES, 2)],
        "f int, " + ", ".join(f"w{k} double" for k in range(many)),
    )
    rows = spark.createDataFrame([(i, [rng.choice(words) for _ in range(rng.randint(1, 12))]) for i in range(3000)], "id int, words array<string>")
    best = license_scan._best(license_scan._weighted(license_scan._features(rows, ["id"]), weights, ["id"]), ["id"], 0.5)
    held = rows.crossJoin(license_scan._margins(weights)).select("id", license_scan._may_be_predicted(F.col("words"), license_scan._least_bound(0.5, 0.6)).alias("may"))
    got = best.join(held, "id").selectExpr("chance >= 0.6 and likely <> 'unknown' as predicted", "may").groupBy("predicted", "may").count().collect()
    counts = {(r.predicted, r.may): r["count"] for r in got}
    assert (True, False) not in counts and counts[True, True] > 100 and counts[False, False] > 100


def test_hints_hold_all_marks():
    """Texts that a family's marks match, written out from the patterns, hold a hint."""
    plain = lambda m: re.sub(r"\\b|\(\?: \|\$\)", "", m).replace(r"\.", ".").replace(r"\d", "4")
    for marks in license_scan.MARKS.values():
        for text in plain(marks[0]).split("|") if "(" not in marks[0] else ["apache license version 2.0", "apache-2.0", "eclipse public license v2.0", "epl-2.0"]:
            assert any(h in text for h in license_scan.HINTS) or re.search(license_scan.SHORT_HINTS, text), text


def test_families_are_told_apart(spark):
    cases = [
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["lgpl-3.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["lgpl-2.1"]),
        ("Released under the ISC License.", ["isc"]),
        ("SPDX-License-Identifier: EPL-2.0", ["epl-2.0"]),
        ("Released under the Unlicense.", ["unlicense"]),
        ("it under the terms of the GNU General Public License as published by", []),
        ("either version 3 of the License, or", []),
        ("This work is licensed under the Quux General Reciprocal License, version 3.", []),
    ]
    cues = [(100 + i, f"Paper {i} asks for a license to {w} under the terms of the office.") for i in range(60) for w in ("fish", "build")]
    docs = spark.createDataFrame([*[(i, t) for i, (t, _) in enumerate(cases)], *cues], "doc_id bigint, text string")
    rows = license_scan.scan(docs).collect()
    assert {r.doc_id: r.families for r in rows if r.doc_id < 100} == {i: f for i, (_, f) in enumerate(cases)}
    assert sum(len(r.families) + r.unconfirmed for r in rows if r.doc_id >= 100) == 0


def test_url_filter(spark):
    d = lambda n: date(2024, 1, n)
    entries = [
        ("a", "domain", "bad.org", "add", d(5)), ("a", "domain", "bad.org", "add", d(7)), ("a", "domain", "bad.org", "remove", d(10)),
        ("b", "host", "x.fine.org", "add", d(1)), ("b", "host", "x.fine.org", "remove", d(1)), ("c", "url", "fine.org/p/q", "add", d(3)),
        ("c", "domain", "org", "add", d(1)), ("d", "domain", "bad.org", "remove", d(2)), ("d", "host", None, "add", d(1)),
        ("e", "host", "www.bad.org", "add", d(5)), (None, "host", "null.list", "add", d(1)), ("f", "what", "bad.org", "add", d(1)),
    ]
    captures = [
        (1, "http://www.bad.org/x", d(4)), (2, "HTTPS://user@www.BAD.org:80/x", d(5)), (3, "http://bad.org", d(10)), (4, "http://notbad.org/", d(6)),
        (5, "http://x.fine.org/p", d(9)), (6, "http://fine.org/p/q/?a=1#f", d(3)), (7, None, d(3)), (8, "no url", d(3)), (9, "http://bad.org/", None),
        (10, "http://null.list/", d(2)), (6, "http://fine.org/p/q", d(3)), (None, "http://a.b.bad.org./", d(9)), (11, "http://localhost/", d(3)),
    ]
    table = spark.createDataFrame(entries, "list string, kind string, value string, action string, at date")
    rows = spark.createDataFrame(captures, "page_id int, url string, fetched date").withColumn("list", F.lit("x")).withColumn("row", F.lit(1))
    got = Counter((r.page_id, r.blocked, r.matches, r.first_list) for r in url_filter.filter_captures(rows, table, "page_id", "url", "fetched").collect())
    clear = [(i, False, 0, None) for i in (1, 3, 4, 5, 7, 8, 9, 11)]
    assert got == Counter([*clear, (2, True, 2, "a"), (6, True, 1, "c"), (6, True, 1, "c"), (10, True, 1, None), (None, True, 1, "a")])
    assert url_filter.filter_captures(rows.limit(0), table, "page_id", "url", "fetched").count() == 0
    assert url_filter.filter_captures(rows, table.limit(0), "page_id", "url", "fetched").filter("blocked").count() == 0


def test_lm(docs, nothing):
    rule = "crc32(cast(doc_id AS string)) % 7 <> 2"
    rows = brute.documents()
    held = lambda i: i is None or brute.crc(i) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in [*brute.words(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for r in rows:
        own = [*brute.words(r[1]), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        expected.append((r[0], held(r[0]), len(own), sum(counts[w] > 0 for w in own), n, round(base, 4)))
    got = lm.score_documents(docs, rule).collect()
    key = lambda t: str(t)
    assert sorted([(*tuple(r)[:5], round(r.base_score, 4)) for r in got], key=key) == sorted(expected, key=key)
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(nothing, rule).count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(2)
    shape = (lm.CLASSES, lm.WIDTH)
    model = lm.Model(
        np.empty(0, np.uint64), rng.normal(0, 0.1, shape), rng.normal(0, 0.1, shape), np.eye(lm.WIDTH), np.eye(lm.WIDTH), np.zeros(lm.CLASSES),
        np.ones(lm.TAILS), 1, 1, 1,
    )
    steps = [(a, b, (b + 1) % 6, 100.0 if c == 0 else 1.0) for a in range(6) for b in range(6) for c in (0,)]
    codes = np.array([(a * lm.CLASSES + b) * lm.CLASSES + c for a, b, c, _ in steps])
    lm.train_network(model, codes, np.array([w for *_, w in steps]))
    chances = 10 ** model.table()
    assert np.allclose(chances.sum(axis=2), 1)
    assert all(chances[a, b].argmax() == c for a, b, c, _ in steps)


def test_lm_network_learns_from_all_counts(monkeypatch):
    """No trigram is drawn: every count has its part in the training, so the shares after one context come out exactly."""
    rng = np.random.default_rng(5)
    shape = (lm.CLASSES, lm.WIDTH)
    model = lm.Model(
        np.empty(0, np.uint64), rng.normal(0, 0.1, shape), rng.normal(0, 0.1, shape), np.eye(lm.WIDTH), np.eye(lm.WIDTH), np.zeros(lm.CLASSES),
        np.ones(lm.TAILS), 1, 1, 1,
    )

    def drawn(*_):
        raise AssertionError("a sample is drawn")

    monkeypatch.setattr(np.random, "default_rng", drawn)
    shares = {1: 0.4, 2: 0.3, 3: 0.2, 4: 0.1}
    lm.train_network(model, np.array([(7 * lm.CLASSES + 9) * lm.CLASSES + c for c in shares]), np.array([1e6 * s for s in shares.values()]))
    chances = 10 ** model.table()[7, 9]
    assert all(abs(chances[c] - s) < 0.005 for c, s in shares.items())


def test_quality(spark, docs, nothing):
    rng = random.Random(4)
    names = brute.vocabulary(rng, 400)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        text = brute.prose(rng, 60 + i % 90, names) if good else " ".join(w.upper() + "!!" for w in brute.prose(rng, 40 + i % 70, names).split())
        rows.append((i, text, "en", "s", 1, "x", None, 1, 1, "w", int(good)))
    all_rows = spark.createDataFrame(rows, brute.SCHEMA + ", quality int")
    labels = all_rows.select("doc_id", "quality")
    trees = quality.train(all_rows.drop("quality"), labels.filter("crc32(cast(doc_id as string)) % 5 <> 0").unionByName(spark.createDataFrame([(None, 1), (3, 9)], labels.schema)))
    scored = quality.score_documents(all_rows, trees, score="q").filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert np.mean([(r.q >= 0.3) == bool(r.quality) for r in scored]) > 0.95
    odd = quality.score_documents(docs, trees, score="q").collect()
    assert len(odd) == len(brute.documents()) and all(0 <= r.q <= 1 for r in odd)
    assert Counter(tuple(r)[:10] for r in odd) == Counter(brute.documents())
    one = quality.train(all_rows.drop("quality"), labels.filter("quality = 1"))
    assert 0 < quality.score_documents(docs, one, score="q").first().q <= 1
    assert quality.score_documents(nothing, trees).count() == 0
    x = np.array([[rng.random() for _ in quality.NAMES] for _ in range(50)])

    def walk(row):
        total = trees.base
        for node in trees.roots:
            for _ in range(trees.depth):
                node = trees.left[node] if row[trees.feature[node]] <= trees.limit[node] else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.raw(x), [walk(r) for r in x])
    assert re.match("log", quality.NAMES[0])

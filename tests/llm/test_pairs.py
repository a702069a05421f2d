"""Deduplication, near duplicates, passages and decontamination against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from attesta.llm import decontam, exact_dedup, ngram_join, substring
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.documents(), brute.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_exact_duplicates(docs, nothing):
    rows = brute.documents()
    key = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for r in rows:
        groups[key(r[1])].append(r[0])
    expected = []
    for r in rows:
        ids = [i for i in groups[key(r[1])] if i is not None]
        keep = min(ids) if ids else None
        expected.append((r[0], keep, len(groups[key(r[1])]), keep is None or r[0] == keep, key(r[1])))
    got = [tuple(x) for x in exact_dedup.exact_duplicates(docs).collect()]
    assert Counter(got) == Counter(expected)
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_index_insert_delete_resize(spark):
    key = lambda i: hashlib.sha256(str(i).encode()).digest()
    change = lambda rows: spark.createDataFrame(rows, exact_dedup.CHANGES)
    first = exact_dedup.change_index(exact_dedup.empty_index(spark), change([(key(i), i, 1, True) for i in range(3000)]), 2)
    second = exact_dedup.change_index(
        first, change([(key(i), 10**6 + i, 2, True) for i in range(10)] + [(key(i), None, 1, False) for i in range(5, 2000)] + [(key("no"), None, 1, False)]), 2
    )
    rows = second.collect()
    live = {bytes(r.digest): (r.keep_id, r.copies) for r in rows if r.digest is not None}
    expected = {key(i): (i, 3) for i in range(5)} | {key(i): (i, 2) for i in range(5, 10)}
    assert live == expected | {key(i): (i, 1) for i in range(2000, 3000)}
    assert all(r.resizes >= 1 for r in first.collect() if r.slots is not None)
    filters = {r.segment: exact_dedup.CuckooFilter(slots=exact_dedup.np.frombuffer(r.slots, dtype="uint16")) for r in rows if r.slots is not None}
    assert all(filters[r.segment].find(bytes(r.digest)) >= 0 for r in rows if r.digest is not None)


@pytest.mark.parametrize("made, keys", [(25, 200_000), (1, 40), (7, 40)])
def test_index_of_other_segments(spark, monkeypatch, made, keys):
    """Repeats of older documents are found whatever number of segments the index and the batch have."""
    monkeypatch.setattr(exact_dedup, "SEGMENT_KEYS", keys)
    key = lambda t: hashlib.sha256(t.encode()).digest()
    changes = spark.createDataFrame([(key(f"text {i}"), i, 1, True) for i in range(300)], exact_dedup.CHANGES)
    index = exact_dedup.change_index(exact_dedup.empty_index(spark), changes, made)
    batch = spark.createDataFrame([(1000 + i, f"text {i}") for i in range(200, 400)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(batch, index=index).collect())
    assert got == [(1000 + i, i, 2, False) if i < 300 else (1000 + i, 1000 + i, 1, True) for i in range(200, 400)]


def _components(rows):
    sets = [brute.shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)].append(r[0])
    return [(r[0], len(s), min(ids[root(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_near_duplicates(docs, nothing):
    got = [tuple(x) for x in ngram_join.near_duplicates(docs).collect()]
    assert Counter(got) == Counter(_components(brute.documents()))
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_shared_passages(docs, nothing):
    rows = [r for r in brute.documents() if r[0] is not None]
    held = defaultdict(set)
    for r in rows:
        w = brute.words(r[1])
        for i in range(len(w) - 49):
            held[tuple(w[i : i + 50])].add(r[0])
    expected = set().union(*[ids for ids in held.values() if len(ids) > 1])
    found = substring.shared_passages(docs).collect()
    assert expected <= {r.doc_id for r in found}
    texts = {r[0]: brute.words(r[1]) for r in rows}
    for r in found:
        a, b = texts[r.doc_id][r.start_word : r.end_word], texts[r.other_doc_id][r.other_start : r.other_end]
        assert r.doc_id != r.other_doc_id and min(len(a), len(b)) >= 50 and r.identity >= 0.8
        assert len(set(a) & set(b)) >= 0.6 * len(set(a))
    pairs = {(r.doc_id, r.other_doc_id) for r in found}
    assert pairs == {(b, a) for a, b in pairs}
    clean = set(texts) - {r[0] for r in rows if len(brute.words(r[1])) >= 50}
    assert not clean & {a for a, _ in pairs}
    assert substring.shared_passages(nothing).count() == 0


@pytest.mark.parametrize("copies", [1, 30])
def test_passages_whose_parts_lie_in_other_documents(spark, copies):
    """Documents that hold only the first or the last words of a passage come first for all of its seeds."""
    rng = random.Random(copies)
    names = brute.vocabulary(rng, 5000)
    passage = brute.prose(rng, 60, names).split(" ")
    own = lambda words: brute.prose(rng, 40, names) + " " + " ".join(words) + " " + brute.prose(rng, 40, names)
    texts = [own(part) for _ in range(copies) for part in (passage[:30], passage[-30:], passage[:45], passage[-45:])]
    whole = range(len(texts), len(texts) + 2)
    texts += [own(passage), own(passage)]
    found = substring.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)).collect()
    assert {(*whole,), (*whole[::-1],)} <= {(r.doc_id, r.other_doc_id) for r in found}
    assert all(r.end_word - r.start_word >= 60 for r in found if {r.doc_id, r.other_doc_id} == set(whole))


def test_neighbouring_anchors_are_aligned_as_one_run(monkeypatch):
    """The work between two edited copies follows from the changes, not from the words that are equal."""
    np = substring.np
    a = np.random.default_rng(5).integers(0, 1 << 31, 2000).astype(np.uint32)
    b = np.concatenate([a[:400], a[405:900], a[890:1500], a[1500:]])
    b[[10, 700, 1200, 1990]] = 7
    whole, calls = substring.columns, []
    monkeypatch.setattr(substring, "columns", lambda x, y: calls.append(1) or whole(x, y))
    aligned = substring.columns(a, b)
    assert aligned[0].sum() == len(a) and aligned[1].sum() == len(b) and aligned[2].sum() == len(a) - 5 - 4
    assert len(calls) < 40


def test_pairs_compared_at_once_are_those_compared_alone():
    """Copies with exact chains, edits near and in the chain, clipped pieces and chains of unequal length."""
    np = substring.np
    rng = np.random.default_rng(8)
    rows, alone = [], []
    for span in range(400):
        a = rng.integers(0, 1 << 31, int(rng.integers(55, 300))).astype(np.uint32)
        b = a.copy()
        b[rng.integers(0, len(b), int(rng.integers(0, 4)))] = 3
        cut = int(rng.integers(0, 3))
        b, lo = b[cut:], int(rng.integers(4, 20))
        hi = len(a) - (int(rng.integers(0, 20)) if span < 399 else 0)  # the last chains end with the pieces
        cores = (lo, hi), (lo - cut, hi - cut - (span % 7 == 0))
        for side, (words, core) in enumerate(zip((a, b), cores)):
            rows.append({"span": span, "side": side, "lo": core[0], "hi": core[1], "start": 10 * side, "words": words.tobytes(), "doc": 2 * span + side})
        for a0, a1, b0, b1, identity in substring.align(a, cores[0], b, cores[1]):
            alone.append((2 * span, a0, a1, 2 * span + 1, b0 + 10, b1 + 10, identity))
    found = [tuple(r.values()) for batch in substring._aligned(substring.pa.Table.from_pylist(rows)) for r in batch.to_pylist()]
    assert {f for f in found if f[0] % 2 == 0} == set(alone) and len(alone) > 300
    assert {f[3:6] + f[:3] + f[6:] for f in found if f[0] % 2} == set(alone)


def test_recall_of_edited_passages(spark):
    """Copies of 60 to 90 words with changed, left out and added words, down to an identity of 0.8; and of less."""
    rng = random.Random(11)
    names = brute.vocabulary(rng, 5000)
    new = lambda: "x" + str(rng.randrange(10**9))
    rows, close, far = [], set(), set()
    for case in range(120):
        one = brute.prose(rng, rng.randint(60, 90), names).split(" ")
        kind, two = case % 4, list(one)
        if kind == 0:
            two = [new() if i % 6 == 5 else w for i, w in enumerate(one)]
        elif kind == 1:
            two = [new() if i % 5 == 4 and i < len(one) - 1 else w for i, w in enumerate(one)]
        elif kind == 2:
            for i in sorted(rng.sample(range(1, len(one) - 1), len(one) // 7), reverse=True):
                two[i : i + 1] = rng.choice([[], [new()], [one[i], new()]])
        else:
            two = [new() if i % 3 == 2 else w for i, w in enumerate(one)]
        (far if kind == 3 else close).add(case)
        for side, words in enumerate((one, two)):
            text = f"{brute.prose(rng, 30, names)} {' '.join(words)} {brute.prose(rng, 30, names)}"
            rows.append((2 * case + side, text))
    found = substring.shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {(r.doc_id, r.other_doc_id) for r in found} == {p for c in close for p in ((2 * c, 2 * c + 1), (2 * c + 1, 2 * c))}
    assert all(r.identity >= 0.8 for r in found)


def test_packed_numbers_come_back():
    np = substring.np
    rng = np.random.default_rng(2)
    for top in (1, 200, 60_000, 1 << 31, 1 << 62):
        values = rng.integers(0, top, 50)
        assert (substring.unpack(substring.pack(values)) == values).all()
        signed = rng.integers(-top, top, 50)
        assert (substring.unpack_steps(substring.pack_steps(signed)) == signed).all()
    ends = np.array([np.iinfo(np.int64).min, np.iinfo(np.int64).max, 0, -1])
    assert (substring.unpack_steps(substring.pack_steps(ends)) == ends).all()
    assert len(substring.pack_steps(np.repeat(np.arange(9), 40))) == 361


@pytest.mark.parametrize("words", [6, 40, 4000])
def test_quick_test_and_anchors_lose_no_passage(words, monkeypatch):
    """Alignments between anchors against plain ones: the same passages, and none is ruled out beforehand."""
    np = substring.np
    rng, seen = np.random.default_rng(words), 0
    for case in range(60):
        n = int(rng.integers(50, 160))
        a = rng.integers(0, words, n).astype(np.uint32)
        b, rate = [], (0.05, 0.12, 0.18, 0.4)[case % 4]
        for w in a:
            kind = rng.random()
            if kind < rate / 3:
                continue
            b.append(rng.integers(0, words) if kind < 2 * rate / 3 else w)
            if kind > 1 - rate / 3:
                b.append(rng.integers(0, words))
        b = np.array(b, dtype=np.uint32)
        with monkeypatch.context() as m:
            m.setattr(substring, "SMALL", 1 << 40)
            plain = substring.columns(a, b)
        aligned = substring.columns(a, b)
        assert aligned[0].sum() == len(a) and aligned[1].sum() == len(b)
        assert (a[np.cumsum(aligned[0])[aligned[2] > 0] - 1] == b[np.cumsum(aligned[1])[aligned[2] > 0] - 1]).all()
        assert (1 - plain[2]).sum() <= (1 - aligned[2]).sum()
        found = substring.passages(plain)
        if found:
            seen += 1
            assert substring._may_share(a, b)
            longest = max(f[1] - f[0] for f in found)
            assert max((f[1] - f[0] for f in substring.passages(aligned)), default=0) >= 0.9 * longest
    assert seen > 15


def test_chains_follow_both_texts():
    np = substring.np
    x = np.array([0, 10, 20, 30, 40, 15, 200, 210])
    y = np.array([5, 15, 24, 35, 45, 90, 300, 310])
    assert (0, 46, 5, 51) in substring.chains(x, y)
    assert (200, 216, 300, 316) in substring.chains(x, y)
    assert substring.distance(np.array([1, 2, 3, 4]), np.array([1, 3, 4, 5])) == 2


def test_decontamination(spark, docs, nothing):
    rows = brute.documents()
    cut = lambda i, a, b: " ".join(brute.words(rows[i][1])[a:b])
    items = [
        (1, cut(50, 0, 30)), (2, cut(0, 20, 60) + " q w e r t"), (3, "A b"), (4, None), (5, " "), (None, cut(0, 0, 40)), (6, cut(0, 0, 12)),
        (7, cut(0, 0, 10) + " x y z k l m n o p"), (6, cut(0, 0, 12)), (8, "a"), (9, cut(144, 0, 3000)), (10, cut(150, 0, 40)),
    ]
    table = spark.createDataFrame(items, "item_id int, text string")
    union = defaultdict(set)
    expected = {}
    for item, text in items:
        w = brute.words(text)
        k = min(5, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for r in rows:
            if r[0] is None or item is None or not grams:
                continue
            d = brute.words(r[1])
            own = {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
            if len(own & grams) * 100 >= 80 * len(grams):
                expected[r[0], item] = (len(grams), len(own & grams))
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in decontam.contaminated(docs, table).collect()}
    assert got == expected and len(got) > 20
    assert decontam.contaminated(nothing, table).count() == 0
    assert decontam.contaminated(docs, table.limit(0)).count() == 0
    assert not union

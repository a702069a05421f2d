"""Whitening and vector codes against plain versions."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from attesta.llm import vector_codes, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n int, component string, code int, width int"
REST = ("x", 3, None, 4, 5)


def vectors(kind: str) -> list[tuple]:
    rng = np.random.default_rng(5)
    if kind == "ordinary":
        data = rng.normal(size=(300, 16)) * np.linspace(0.05, 2, 16)
    elif kind == "wide scales":
        data = rng.normal(size=(400, 16)) * 10.0 ** np.linspace(-1, 4.4, 16)
    elif kind == "dependent":
        data = rng.normal(size=(200, 16)).round(1)
        data[:, 3] = 0.5
        data[:, 7] = data[:, 5]
    elif kind == "few rows":
        data = rng.normal(size=(5, 16))
    rows = [(i * 3 + 1, v.astype(np.float32).tolist(), int(i) % 7 if i % 5 else None, *REST) for i, v in enumerate(data)]
    odd = rows[0][1]
    rows += [
        (2, None, 1, *REST),
        (3, [], 1, *REST),
        (5, [*odd[:-1], None], 1, *REST),
        (6, [*odd[:-1], math.nan], 1, *REST),
        (8, [-math.inf, *odd[1:]], 1, *REST),
        (9, odd[:8], 1, *REST),
        rows[1],
        rows[1],
        (None, rows[2][1], None, *REST),
    ]
    return rows


def kept(rows: list[tuple]) -> list[tuple]:
    return [r for r in rows if r[1] is not None and len(r[1]) == 16 and all(c is not None and math.isfinite(c) for c in r[1])]


@pytest.mark.parametrize("kind", ["ordinary", "wide scales", "dependent", "few rows"])
def test_whitening(spark, kind):
    rows = vectors(kind)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    used = kept(rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in used], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = n * x - sums
    exact = defaultdict(list)
    for r, d in zip(used, (far * far).sum(axis=1), strict=True):
        exact[r[0]].append(d)
    assert len(got) == n * 16 and {r.n for r in got} == {n}
    for key, values in exact.items():
        assert sorted(int(r.deviation) for r in got if r.vec_id == key and r.component == 1) == sorted(values)
    mean = np.array([float(v) for v in far.ravel()]).reshape(far.shape) / n
    _, singular, axes = np.linalg.svd(mean, full_matrices=False)
    values, axes = np.append(singular**2 / n, np.zeros(16 - len(singular))), axes.T
    trace = float(Fraction(int((far * far).sum()), n**3))
    alive = [k for k in range(16) if values[k] > 1e-20 * trace]
    assert len(alive) == {"dependent": 14, "few rows": 4}.get(kind, 16)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    for k in range(16):
        mine = sorted(((r.vec_id or -1, r.deviation), r.whitened, r.explained) for r in got if r.component == k + 1)
        if k not in alive:
            assert all(w is None and e == 0 for _, w, e in mine)
            continue
        assert all(e == pytest.approx(values[k] / trace, rel=1e-6) for _, _, e in mine)
        w = mean @ axes[:, k] / math.sqrt(values[k])
        theirs = sorted(((r[0] or -1, d), v) for r, d, v in zip(used, (far * far).sum(axis=1), w, strict=True))
        a, b = np.array([m[1] for m in mine]), np.array([t[1] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-5


def test_whitening_of_equal_rows_and_of_nothing(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, *REST) for i in range(4)], SCHEMA)
    got = whitening.whiten(same).collect()
    assert len(got) == 8
    assert all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in got)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="out of range"):
        whitening.whiten(spark.createDataFrame([(1, [1e30], 1, *REST)], SCHEMA)).collect()


def test_numerators_beyond_64_bits():
    x = np.array([[1 << 40, 0], [-(1 << 40), 5]])
    n, sums = 10**9, np.array([0, 5 * 10**8], dtype=object)
    assert whitening.deviations(x, n, sums).tolist() == [(n << 40) ** 2 + (5 * 10**8) ** 2, (n << 40) ** 2 + (5 * n - 5 * 10**8) ** 2]
    assert whitening.centred(x, n, sums).tolist() == [[float(1 << 40), -0.5], [-float(1 << 40), 4.5]]


@pytest.mark.parametrize("entries, width, spread", [(1, 3, 5), (16, 8, 3), (16, 8, 1000), (64, 2, 4), (150, 4, 30)])
def test_masks_give_the_exact_nearest_entry(entries, width, spread):
    rng = np.random.default_rng(entries)
    book = rng.integers(-spread, spread, (entries, width))
    points = np.concatenate([rng.integers(-2 * spread, 2 * spread, (500, width)), book])
    far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    index = vector_codes.MaskIndex(book)
    for guess in (None, rng.integers(0, entries, len(points))):
        at, best = index.nearest(points, guess)
        assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    masks = index.candidates(points, np.full(len(points), 2))
    inside = (np.abs(points[:, None] - book[None]) <= 2).all(axis=2)
    bits = (masks[:, np.arange(entries) // 64] >> (np.arange(entries) % 64).astype(np.uint64)) & np.uint64(1)
    assert (bits.astype(bool) == inside).all()


def plain_codes(rows: list[tuple], rounds: int = 6) -> dict:
    used = sorted(kept(rows), key=lambda r: (r[0] is None, r[0], r[1]))
    x = [[math.floor(4096 * c) for c in r[1]] for r in used]
    pieces = [[v[p * 2 : p * 2 + 2] for p in range(8)] for v in x]
    books = [[piece[p] for piece in pieces[:16]] for p in range(8)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def nearest(piece, book):
        return min((far(piece, e), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            own = defaultdict(list)
            for piece in pieces:
                own[nearest(piece[p], books[p])[1]].append(piece[p])
            books[p] = [[sum(c) // len(c) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, totals = [], defaultdict(int)
    for r, piece in zip(used, pieces, strict=True):
        near = [nearest(piece[p], books[p]) for p in range(8)]
        error = sum(d for d, _ in near)
        totals[r[2]] += error
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in near), error))
    return {"rows": sorted(((a or -1), c, e, totals[label], digest) for a, label, c, e in out)}


@pytest.mark.parametrize("kind", ["ordinary", "dependent", "few rows"])
@pytest.mark.parametrize("limit", [vector_codes.BROADCAST_BYTES, 0])
def test_vector_codes(spark, kind, limit, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_BYTES", limit)
    rows = vectors(kind)
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    mine = sorted(((r.vec_id or -1), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got)
    assert mine == plain_codes(rows)["rows"]


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 12, 1, *REST)], SCHEMA))
    with pytest.raises(ValueError, match="256"):
        vector_codes.compress(spark.createDataFrame([], SCHEMA), entries=300)

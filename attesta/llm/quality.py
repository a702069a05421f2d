"""Text quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.words import BLOCK, buffers, word_runs

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 80, 4, 32, 0.15, 8
NAMES = [
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "lower", "digits", "space", "line_breaks", "other",
    "commas", "periods", "exclamation", "pipes", "marks", "slashes", "brackets", "distinct_words", "top_word",
    "distinct_pairs", "distinct_lines", "repeated_bytes", "mean_line",
]


def _byte_class(*ranges: object) -> np.ndarray:
    member = np.zeros(256, dtype=bool)
    for r in ranges:
        member[[ord(c) for c in r] if isinstance(r, str) else slice(*r)] = True
    return member


CLASSES = np.stack(
    [
        _byte_class((65, 91)), _byte_class((97, 123)), _byte_class((48, 58)), _byte_class(" \t\r"), _byte_class("\n"),
        _byte_class((128, 256)), _byte_class(","), _byte_class("."), _byte_class("!"), _byte_class("|"),
        _byte_class("#$%&*@^~"), _byte_class("/\\"), _byte_class("<>{}[]()"),
    ]
).astype(np.float64)


def _repeats(values: np.ndarray) -> tuple[float, float]:
    """Share of distinct values and share of the most frequent one."""
    if len(values) == 0:
        return 1.0, 0.0
    _, counts = np.unique(values, return_counts=True)
    return len(counts) / len(values), counts.max() / len(values)


def _line_stats(data: np.ndarray) -> tuple[float, float, float]:
    """Share of distinct lines, bytes in repeated lines, mean bytes of a line."""
    lines = [x for x in data.tobytes().split(b"\n") if x.strip()]
    if not lines:
        return 1.0, 0.0, 0.0
    once = set(lines)
    total = sum(map(len, lines))
    return len(once) / len(lines), 1 - sum(map(len, once)) / max(total, 1), total / len(lines)


def statistics(texts: pa.Array) -> np.ndarray:
    """The numbers NAMES of every whole text; an empty or null text has zero lengths and no repeats."""
    data, at = buffers(texts)
    out = np.zeros((len(at) - 1, len(NAMES)))
    for first, hashes, bounds, _ in word_runs(texts):
        for i in range(len(bounds) - 1):
            row, words = first + i, hashes[bounds[i] : bounds[i + 1]]
            body = data[at[row] : at[row + 1]]
            counts = np.zeros(256)
            for piece in range(0, len(body), BLOCK):
                counts += np.bincount(body[piece : piece + BLOCK], minlength=256)
            n, w = max(len(body), 1), len(words)
            distinct, top = _repeats(words)
            pairs, _ = _repeats(words[1:] * np.uint64(31) + words[:-1]) if w > 1 else (1.0, 0.0)
            blank = counts[[9, 10, 11, 12, 13, 32]].sum()
            letters = len(body) - blank
            out[row] = [
                np.log1p(len(body)), np.log1p(w), letters / max(w, 1), letters / max(n, 1),
                *(CLASSES @ counts / n), distinct, top, pairs, *_line_stats(body),
            ]
    return out


@dataclass
class Trees:
    """All trees as flat arrays: node i tests ``feature[i] <= limit[i]`` and goes left, else right;
    leaves point to themselves. ``roots`` are the first nodes of the trees."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.limit[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0/1 on the log loss; without both labels, the constant share of 1."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    nodes: list[list[float]] = []  # feature, limit, left, right, value
    roots: list[int] = []
    raw = np.full(len(x), base)

    def leaf(g: float, h: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), -RATE * g / (h + 1.0)])
        return len(nodes) - 1

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * LEAST:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
        if best[1] < 0:
            number = leaf(g, h)
            raw[rows] += nodes[number][4]
            return number
        number = len(nodes)
        nodes.append([best[1], float(edges[best[1]][best[2]]), 0, 0, 0.0])
        low = binned[rows, best[1]] <= best[2]
        nodes[number][2] = grow(rows[low], grad, hess, depth - 1)
        nodes[number][3] = grow(rows[~low], grad, hess, depth - 1)
        return number

    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), DEPTH))
    flat = np.array(nodes or [[0, 0.0, 0, 0, 0.0]])
    return Trees(
        flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4],
        np.array(roots or [0]), base, DEPTH,
    )


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), flat)
        yield pa.RecordBatch.from_arrays([batch.column("y"), lists], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees fitted on the labelled documents, at most ``sample`` of them (the smallest hashes of the id).

    Labels other than 0 and 1 and null ids are ignored; of repeated labels of an id the
    smallest counts.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_).isNotNull())
    known = known.groupBy(id_).agg(F.min(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64(id_), id_).limit(sample)
    rows = docs.select(id_, F.col(text).alias("text")).join(F.broadcast(chosen), id_).select("text", "y")
    got = rows.mapInArrow(_stats_of, "y double, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(NAMES))
    y = got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the fit must not depend on the order in which tasks end
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, trees: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """The given rows, all columns kept, with ``score`` (0 to 1) appended; empty and null texts get one too."""
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(trees.score(statistics(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, schema)

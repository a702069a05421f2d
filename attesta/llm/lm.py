"""Log-bilinear language model, trained by noise-contrastive estimation, over classes of words.

Frequent words and the end of a text are classes of their own; every other word falls into
one of TAILS classes by its last two bytes. The network predicts the class of a token from
the classes of the two before it; inside a tail class a word has its smoothed corpus share.
Both parts sum to one, so token probabilities are normalised over all possible words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import long_column, mix, word_runs
from attesta.session import staged

HEADS, TAILS = 63, 32
CLASSES = 1 + HEADS + TAILS
WIDTH, STEPS, NOISE, RATE = 24, 300, 16, 0.03
KNOWN_BITS = 20


def _tail(codes: np.ndarray) -> np.ndarray:
    return (mix(codes.astype(np.uint64)) % np.uint64(TAILS)).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words, _, codes in word_runs(batch.column("text")):
            if len(words):
                found, at, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [long_column(found), pa.array(_tail(codes[at])), pa.array(n)], names=["word", "tail", "c"]
                )


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, tail, c): every word of the ``text`` column as its hash, its tail class and its count."""
    parts = texts.select("text").mapInArrow(_counts, "word bigint, tail int, c bigint")
    return parts.groupBy("word").agg(F.max("tail").alias("tail"), F.sum("c").alias("c"))


@dataclass
class Model:
    """``heads`` are sorted word hashes, class 1 + position; class 0 is the end, the last TAILS are tails."""

    heads: np.ndarray
    context: np.ndarray  # class vectors as context
    target: np.ndarray  # class vectors as prediction
    near: np.ndarray  # matrix of the word before
    far: np.ndarray  # matrix of the word before that
    bias: np.ndarray
    tail_size: np.ndarray  # tokens + words + 1 of each tail class
    tokens: int
    words: int
    ends: int

    def table(self) -> np.ndarray:
        """log10 probability of every class after every two classes, by one matrix product per far class."""
        near, far = self.context @ self.near, self.context @ self.far
        out = np.empty((CLASSES, CLASSES, CLASSES), dtype=np.float64)
        for k in range(CLASSES):
            raw = (near + far[k]) @ self.target.T + self.bias
            raw -= raw.max(axis=1, keepdims=True)
            out[k] = (raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))) / np.log(10)
        return out

    def classes(self, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = 1 + len(self.heads) + _tail(codes).astype(np.int64)
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, words), len(self.heads) - 1)
            out = np.where(self.heads[at] == words, 1 + at, out)
        return out


def _with_ends(values: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """Values of consecutive texts with ``end`` after each text."""
    return np.insert(values, bounds[1:], end)


def _contexts(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token, ends included, and the two classes before it; a text starts after two ends."""
    now = _with_ends(classes, bounds, 0)
    near = np.concatenate([[0], now[:-1]])
    far = np.concatenate([[0, 0], now[:-2]])[: len(now)]
    far[bounds[:-1] + np.arange(len(bounds) - 1)] = 0
    return now, near, far


def _trigrams(texts: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            for _, words, bounds, codes in word_runs(batch.column("text")):
                now, near, far = _contexts(model.classes(words, codes), bounds)
                total += np.bincount((far * CLASSES + near) * CLASSES + now, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["code", "c"])

    parts = texts.select("text").mapInArrow(run, "code int, c bigint")
    return parts.groupBy("code").agg(F.sum("c").alias("c"))


def train_network(model: Model, codes: np.ndarray, counts: np.ndarray) -> None:
    """Fit the vectors to all class trigrams, each with its count.

    The noise is the class distribution; the score of a class is its log probability up to
    the noise, so the network learns to tell true classes from NOISE ones of it. There are few
    classes, so each step takes the expected loss of the whole table and nothing is drawn.
    """
    unigram = np.bincount(codes % CLASSES, counts, CLASSES) + 0.5
    noise = unigram / unigram.sum()
    model.bias = np.log(noise)
    if not len(codes):
        return
    seen, at = np.unique(codes // CLASSES, return_inverse=True)
    far, near = seen // CLASSES, seen % CLASSES
    true = np.bincount(at * CLASSES + codes % CLASSES, counts / counts.sum(), len(seen) * CLASSES).reshape(len(seen), CLASSES)
    both = true + true.sum(axis=1, keepdims=True) * noise * NOISE
    names = ["context", "target", "near", "far", "bias"]
    first = {n: np.zeros_like(getattr(model, n)) for n in names}
    second = {n: np.zeros_like(getattr(model, n)) for n in names}
    log_noise, every = np.log(noise * NOISE), np.arange(CLASSES)[:, None]
    is_near, is_far = (near[None] == every).astype(float), (far[None] == every).astype(float)
    for step in range(1, STEPS + 1):
        a, b = model.context[near], model.context[far]
        predicted = a @ model.near + b @ model.far
        scores = predicted @ model.target.T + model.bias
        # error of each class after each two classes, true ones and noise together
        spread = both / (1 + np.exp(-np.clip(scores - log_noise, -30, 30))) - true
        back = spread @ model.target
        g = {
            "target": spread.T @ predicted,
            "bias": spread.sum(axis=0),
            "near": a.T @ back,
            "far": b.T @ back,
            "context": is_near @ (back @ model.near.T) + is_far @ (back @ model.far.T),
        }
        rate = RATE * (1 - 0.9 * step / STEPS)
        for n in names:
            first[n] += 0.1 * (g[n] - first[n])
            second[n] += 0.01 * (g[n] ** 2 - second[n])
            corrected = np.sqrt(second[n] / (1 - 0.99**step)) + 1e-9
            getattr(model, n)[...] -= rate * first[n] / (1 - 0.9**step) / corrected


def train(texts: DataFrame, words: DataFrame) -> Model:
    """A model of the ``text`` column; ``words`` is its vocabulary. Counts cover all texts; what the
    driver gets is bounded by the number of classes."""
    ends = texts.count()
    heads = np.array([r["word"] for r in words.orderBy(F.desc("c"), "word").limit(HEADS).collect()], dtype=np.int64)
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tails = words.filter(~F.col("word").isin([int(h) for h in heads])) if len(heads) else words
    size = np.ones(TAILS)
    for r in tails.groupBy("tail").agg((F.sum("c") + F.count("*")).alias("n")).collect():
        size[r["tail"]] += r["n"]
    rng = np.random.default_rng(11)
    vectors = lambda *shape: rng.normal(0, 0.1, shape)
    model = Model(
        np.sort(heads.view(np.uint64)), vectors(CLASSES, WIDTH), vectors(CLASSES, WIDTH), np.eye(WIDTH), 0.5 * np.eye(WIDTH),
        np.zeros(CLASSES), size, total + ends, distinct + (ends > 0), ends,
    )
    found = _trigrams(texts, model).toArrow()
    codes, counts = found["code"].to_numpy().astype(np.int64), found["c"].to_numpy()
    order = np.argsort(codes)
    train_network(model, codes[order], counts[order].astype(float))
    return model


def _frequent(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most 2^KNOWN_BITS of them: those of at least the
    smallest power of two for which they fit."""
    bits = F.floor(F.log2("c")).cast("int")
    sizes = {r["b"]: r["n"] for r in words.groupBy(bits.alias("b")).agg(F.count("*").alias("n")).collect()}
    least, held = 64, 0
    for b in sorted(sizes, reverse=True):
        if held + sizes[b] > 1 << KNOWN_BITS:
            break
        least, held = b, held + sizes[b]
    rows = words.filter(F.col("c") >= F.lit(2.0) ** least).select("word", "c").toArrow()
    known, counts = rows["word"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


SCORED = "row bigint, word bigint, tf bigint, tail int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"
_tables: dict[bytes, np.ndarray] = {}


def _table(model: Model) -> np.ndarray:
    """The table of a model, made once per Python worker."""
    key = model.target.tobytes()
    if key not in _tables:
        _tables.clear()
        _tables[key] = model.table()
    return _tables[key]


def _score_run(model: Model, known: np.ndarray, counts: np.ndarray, words: np.ndarray, bounds: np.ndarray, codes: np.ndarray):
    """Per text: known tokens, base and score without the rare words; and the rare words: text, word, tail, times."""
    table, n = _table(model), len(bounds) - 1
    classes = model.classes(words, codes)
    now, near, far = _contexts(classes, bounds)
    text_of = np.repeat(np.arange(n), np.diff(bounds) + 1)
    score = np.bincount(text_of, table[far, near, now], n)
    denominator = np.log10(model.tokens + model.words + 1)
    base = np.full(n, np.log10(model.ends + 1) - denominator)
    tail = classes - 1 - len(model.heads)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
    hit = known[at] == words if len(known) else np.zeros(len(words), dtype=bool)
    logs = np.log10(counts[at[hit]] + 1.0) if hit.any() else np.empty(0)
    base += np.bincount(owner[hit], logs - denominator, n)
    in_tail = tail[hit] >= 0
    score += np.bincount(owner[hit][in_tail], logs[in_tail] - np.log10(model.tail_size[tail[hit][in_tail]]), n)
    n_known = np.bincount(owner[hit], minlength=n) + (model.ends > 0)
    rare = np.flatnonzero(~hit)
    order = rare[np.lexsort((words[rare], owner[rare]))]
    if not len(order):
        return n_known, base, score, order, order, order, order
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    firsts = np.flatnonzero(new)
    times = np.diff(np.append(firsts, len(order)))
    chosen = order[firsts]
    return n_known, base, score, owner[chosen], words[chosen], tail[chosen], times


def score_documents(docs: DataFrame, learn: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` is a SQL condition; documents for which it is not true are held out of all
    counts. Tokens are the words and one end. ``base_score`` sums log10((c + 1) / (N + V + 1)),
    ``score`` is the log10 probability of the text under the model. Null and empty texts are
    the end alone. Without training texts all counts are 0. Repeated rows get a row each; an
    empty table gives none. Extra columns are not read.

    Frequent words (2^20 at most) are known to every task; the counts of the rare ones meet
    their documents in a join, one row per document and rare word.
    """
    rows = docs.select(
        F.col(id_).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        (~F.coalesce(F.expr(learn), F.lit(False))).alias("held_out"),
    )
    texts = rows.filter(~F.col("held_out"))
    words = staged(vocabulary(texts))
    model = train(texts, words)
    frequent = docs.sparkSession.sparkContext.broadcast((model, *_frequent(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, counts = frequent.value
        names = [f.split()[0] for f in SCORED.split(", ")]
        for batch in batches:
            for first, hashes, bounds, codes in word_runs(batch.column("text")):
                part = batch.slice(first, len(bounds) - 1)
                n_known, base, score, who, rare, tail, times = _score_run(own, known, counts, hashes, bounds, codes)
                row = part.column("row")
                n, zero = len(row), pa.array(np.zeros(len(row), dtype=np.int64))
                # a document's own line goes to the join under a number of its own, so these spread evenly
                yield pa.RecordBatch.from_arrays(
                    [row, long_column(mix(row.to_numpy().view(np.uint64))), zero, zero.cast(pa.int32()), part.column("doc_id"),
                     part.column("held_out"), pa.array(np.diff(bounds) + 1), pa.array(n_known), pa.array(base), pa.array(score)],
                    names=names,
                )
                if len(who):
                    blank = [pa.nulls(len(who), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays(
                        [row.take(pa.array(who)), long_column(rare), pa.array(times), pa.array(tail.astype(np.int32)), *blank], names=names
                    )

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    parts = numbered.mapInArrow(run, SCORED).join(words.select("word", "c"), "word", "left")
    count = F.when(F.col("tf") > 0, F.coalesce("c", F.lit(0)))
    size = F.get(F.array(*[F.lit(float(s)) for s in model.tail_size]), F.col("tail"))
    rare_base = F.col("tf") * (F.log10(count + 1) - F.lit(float(np.log10(model.tokens + model.words + 1))))
    rare_score = F.col("tf") * (F.log10(count + 1) - F.log10(size))
    return (
        parts.groupBy("row")
        .agg(
            F.max("doc_id").alias(id_),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            (F.sum("n_known") + F.sum(F.when(count > 0, F.col("tf")).otherwise(0))).alias("n_known"),
            F.lit(int(model.tokens)).cast("bigint").alias("train_tokens"),
            F.sum(F.coalesce("base", rare_base)).alias("base_score"),
            F.sum(F.coalesce("score", rare_score)).alias("score"),
        )
        .drop("row")
    )

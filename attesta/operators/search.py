"""Similarity search, diversity reranking and citation assembly over whole tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attesta.functions.governance import confidence_of, min_trust_ok, search_contexts, stored_subject
from attesta.functions.text import is_blank
from attesta.operators.ranking import top_k_per_query
from attesta.rules import CONFESSIONS, MMR_LAMBDA, SEARCH_LIMIT, SUBJECTS, TOP_K
from attesta.session import staged

# Queries go to the points in blocks of at most this size, one pass over the points per block.
BROADCAST_BYTES = 64 << 20
QUERY_BYTES = 1_000  # of a query besides its vector: id, clauses, Python objects
BROADCAST_ROWS = 1_000_000  # id and score of a hit: about 30 bytes
PASS_BLOCKS = 8  # blocks that one pass over the points serves
QUERY_STRIP = 256  # queries scored at a time inside a task


def _hit_schema(queries: DataFrame, points: DataFrame) -> T.StructType:
    return T.StructType(
        [queries.schema["query_id"], points.schema["point_id"], T.StructField("score", T.DoubleType())]
    )


def payload_filter(
    df: DataFrame,
    trust_not: str | None = None,
    subject: str | None = None,
    confessions: list[str] | None = None,
    source_id=None,
) -> DataFrame:
    """Rows that pass all given clauses.

    A missing trust level passes ``trust_not``; a missing subject or confession
    fails its clause; an empty confession list is no clause.
    """
    condition = filter_condition(trust_not, subject, confessions, source_id)
    return df if condition is None else df.filter(condition)


def filter_condition(trust_not=None, subject=None, confessions=None, source_id=None) -> Column | None:
    """The clauses of a payload filter as one null-safe condition, None when there are none."""
    clauses = []
    if trust_not:
        clauses.append(~F.col("trust_level").eqNullSafe(F.lit(trust_not)))
    if subject:
        clauses.append(F.col("subject").eqNullSafe(F.lit(subject)))
    if confessions:
        clauses.append(F.coalesce(F.col("confession_context").isin(confessions), F.lit(False)))
    if source_id is not None:
        clauses.append(F.col("source_id").eqNullSafe(F.lit(source_id)))
    if not clauses:
        return None
    out = clauses[0]
    for clause in clauses[1:]:
        out = out & clause
    return out


def min_trust(df: DataFrame, level: str) -> DataFrame:
    """Rows whose trust level reaches the floor (apply after the limit, never before)."""
    return df.filter(min_trust_ok("trust_level", level))


# ---- exact search --------------------------------------------------------------


def _codes(values, domain: list[str]) -> np.ndarray:
    """Position in the domain, -1 for null, a foreign value gets the code after the last."""
    column = values if isinstance(values, pa.Array) else pa.array(list(values), pa.string(), from_pandas=True)
    found = pc.index_in(column, value_set=pa.array(domain)).fill_null(len(domain)).to_numpy(zero_copy_only=False)
    return np.where(column.is_null().to_numpy(zero_copy_only=False), -1, found)


def _matrix(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: (row numbers, matrix in double)."""
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_length.setdefault(0 if v is None else len(v), []).append(i)
    return {
        n: (np.array(rows), np.array([vectors[i] for i in rows], dtype=np.float64).reshape(len(rows), n))
        for n, rows in by_length.items()
    }


def _arrow_matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Like ``_matrix`` without touching single values when all lengths agree."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all() and column.null_count == 0 and lengths[0] > 0:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return {int(lengths[0]): (np.arange(len(lengths)), flat.reshape(len(lengths), -1))}
    return _matrix(column.to_pylist())


SCORE_DIGITS = 12


class QueryBlock:
    """Queries as matrices, with the codes of their payload clauses."""

    def __init__(self, rows: pd.DataFrame, limit: int):
        self.limit = limit
        self.ids = rows["query_id"].to_numpy()
        self.matrices = {
            n: (where, m, np.sqrt((m * m).sum(axis=1))) for n, (where, m) in _matrix(list(rows["vector"])).items()
        }
        self.subjects = _codes(rows["subject"].where(rows["subject"].notna(), None), SUBJECTS)
        self.contexts = np.ones((len(rows), len(CONFESSIONS) + 2), dtype=bool)
        for i, allowed in enumerate(rows["contexts"]):
            if allowed is not None and len(allowed) > 0:
                self.contexts[i] = False
                self.contexts[i, _codes(allowed, CONFESSIONS)] = True

    def scores(self, block: slice, points: dict) -> np.ndarray:
        """Cosine of the queries in ``block`` with a batch of points; 0 where undefined."""
        first, last = block.start, block.stop
        out = np.zeros((last - first, sum(len(where) for where, _ in points.values())))
        for n, (rows, m, norms) in self.matrices.items():
            mine = (rows >= first) & (rows < last)
            if n in points and n > 0 and mine.any():
                where, p = points[n]
                denominator = np.outer(norms[mine], np.sqrt((p * p).sum(axis=1)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[np.ix_(rows[mine] - first, where)] = np.where(denominator == 0, 0.0, (m[mine] @ p.T) / denominator)
        # the last bits of a block product depend on the block: rounded, equal vectors tie and the id decides
        return np.round(out, SCORE_DIGITS)

    def best(self, ids: np.ndarray, points: dict, subject: np.ndarray, context: np.ndarray, kept: list) -> list:
        """Merge a batch of points into the best hits kept so far for every query.

        Scores are taken for a few hundred queries at a time. Once a query holds
        ``limit`` hits, only batches with a score that reaches its worst one matter.
        """
        floors = np.array([k[0].min() if k is not None and len(k[0]) >= self.limit else -np.inf for k in kept])
        for first in range(0, len(self.ids), QUERY_STRIP):
            block = slice(first, min(first + QUERY_STRIP, len(self.ids)))
            scores = self.scores(block, points)
            wanted = self.subjects[block][:, None]
            ok = self.contexts[block][:, context] & ((wanted < 0) | (wanted == subject[None, :]))
            ok &= scores >= floors[block][:, None]
            for i in np.flatnonzero(ok.any(axis=1)):
                row, row_ids = scores[i][ok[i]], ids[ok[i]]
                held = kept[first + i]
                if held is not None:
                    row, row_ids = np.concatenate([held[0], row]), np.concatenate([held[1], row_ids])
                if len(row) > self.limit:
                    floor = np.partition(row, len(row) - self.limit)[len(row) - self.limit]
                    row, row_ids = row[row >= floor], row_ids[row >= floor]
                    order = sorted(range(len(row)), key=lambda j: (-row[j], row_ids[j]))[: self.limit]
                    row, row_ids = row[order], row_ids[order]
                kept[first + i] = (row, row_ids)
        return kept

    def hits(self, kept: list, types: list) -> pa.RecordBatch:
        rows = [(q, i, s) for q, k in zip(self.ids, kept) if k is not None for s, i in zip(k[0].tolist(), k[1].tolist())]
        columns = list(zip(*rows)) if rows else [[], [], []]
        query_ids = [q.item() if hasattr(q, "item") else q for q in columns[0]]
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids, types[0]), pa.array(columns[1], types[1]), pa.array(columns[2], types[2])],
            names=["query_id", "point_id", "score"],
        )


def _sent(blocks: list[DataFrame], limit: int) -> list[Broadcast]:
    # one block at a time is on the driver
    return [b.sparkSession.sparkContext.broadcast(QueryBlock(b.toPandas(), limit)) for b in blocks]


def _shared_pass(sent: list[Broadcast], points: DataFrame, schema) -> DataFrame:
    """The best hits of every scan task for all queries of some blocks, in one pass over the points."""
    types = [to_arrow_type(f.dataType) for f in schema]

    def scan(batches):
        mine = [b.value for b in sent]
        kept = [[None] * len(m.ids) for m in mine]
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("point_id").to_numpy(zero_copy_only=False)
                vectors = _arrow_matrix(batch.column("vector"))
                subject, context = _codes(batch.column("subject"), SUBJECTS), _codes(batch.column("confession_context"), CONFESSIONS)
                kept = [m.best(ids, vectors, subject, context, k) for m, k in zip(mine, kept, strict=True)]
        for m, k in zip(mine, kept, strict=True):
            yield m.hits(k, types)

    return points.mapInArrow(scan, schema)


def _block_search(queries: DataFrame, points: DataFrame, limit: int, blocks: int) -> DataFrame:
    """Best hits of every task for all queries. Up to ``PASS_BLOCKS`` blocks share a pass over the points;
    where more passes are needed, only the short lists of each are written, and its blocks are given up."""
    schema = _hit_schema(queries, points)
    if blocks == 1:
        return _shared_pass(_sent([queries], limit), points, schema)
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [queries.filter(number == i) for i in range(blocks)]
    passes = [parts[i : i + PASS_BLOCKS] for i in range(0, blocks, PASS_BLOCKS)]
    if len(passes) == 1:
        return _shared_pass(_sent(parts, limit), points, schema)
    found = []
    for part in passes:
        sent = _sent(part, limit)
        found.append(staged(top_k_per_query(_shared_pass(sent, points, schema), limit).drop("rank")))
        for block in sent:
            block.destroy()
    return reduce(DataFrame.unionByName, found)


def search(
    queries: DataFrame,
    points: DataFrame,
    limit: int = SEARCH_LIMIT,
    trust_not: str | None = "UNVERIFIED",
    broadcast_bytes: int = BROADCAST_BYTES,
    measured: tuple[int, int] | None = None,
) -> DataFrame:
    """Exact filtered cosine search: the best ``limit`` points for every query.

    ``queries``: query_id, vector, subject (null = any), contexts (null or empty = any).
    ``points``: point_id, vector, trust_level, subject, confession_context.

    Vectors are not shuffled: the measured queries go to the data in blocks of at most
    ``broadcast_bytes``, each scan task keeps ``limit`` hits per query, and only those
    reach the final ranking. Scores count to 12 digits; ties go to the smaller id.
    """
    q = queries.select(
        "query_id",
        "vector",
        F.col("subject").cast("string").alias("subject"),
        F.col("contexts").cast("array<string>").alias("contexts"),
    )
    p = payload_filter(points, trust_not=trust_not).select(
        "point_id", "vector", "subject", "confession_context"
    )
    n, dims = measured or measure(q)
    # a vector is held as a list on its way into the matrix, so it counts several times
    blocks = max(1, -(-n * (dims * 32 + QUERY_BYTES) // max(broadcast_bytes, 1)))
    return top_k_per_query(_block_search(q, p, limit, min(blocks, max(n, 1))), limit)


def measure(queries: DataFrame) -> tuple[int, int]:
    """Number of queries and longest vector (stage queries that are costly to compute)."""
    return tuple(queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first())


def attach(hits: DataFrame, points: DataFrame, at_most: int | None = None) -> DataFrame:
    """Payload and vector of the hits, read back by id.

    ``at_most`` is a proven bound on the number of hits; below ``BROADCAST_ROWS`` the hits go
    to the points, so the points are scanned and not shuffled. Beyond, a bit map of the
    ids of the hits goes there first, so only points that were hit, and about one in ``BITS_PER_ID``
    of the others, leave the scan for the join.
    """
    if at_most is not None and at_most <= BROADCAST_ROWS:
        return points.join(F.broadcast(hits), "point_id")
    hits = staged(hits)
    # stored hits are far smaller on disk than as rows: never broadcast
    return points_hit(points, hits, hits.count()).join(hits.hint("merge"), "point_id")


BITS_PER_ID = 32
MAP_BYTES = 256 << 20
_BUCKET_BITS = 32_768  # of one row of Spark's bitmap aggregate


def points_hit(points: DataFrame, hits: DataFrame, n: int, key: str = "point_id") -> DataFrame:
    """The points whose id is, or may be, among those of ``n`` hits: no point of a hit is lost.

    One bit for each hash of an id, in rows of 4 KB. These are broadcast: at most
    ``MAP_BYTES`` whatever ``n`` is, with more false hits where that bounds the bits of an id.
    """
    bits = min(max(n, 1) * BITS_PER_ID, MAP_BYTES * 8)
    buckets = -(-bits // _BUCKET_BITS)
    spot = F.pmod(F.xxhash64(key), F.lit(buckets * _BUCKET_BITS))
    rows = hits.select(F.floor(spot / _BUCKET_BITS).alias("_bucket"), F.pmod(spot, F.lit(_BUCKET_BITS)).alias("_bit"))
    maps = rows.groupBy("_bucket").agg(F.bitmap_construct_agg(F.col("_bit")).alias("_map"))
    placed = points.withColumn("_bucket", F.floor(spot / _BUCKET_BITS)).withColumn("_bit", F.pmod(spot, F.lit(_BUCKET_BITS)))
    # bit b of a row is bit b % 8 of its byte b / 8
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte.cast("bigint"), F.pmod(F.col("_bit"), F.lit(8)).cast("int")) == 1
    return placed.join(F.broadcast(maps), "_bucket").filter(is_set).select(*points.columns)


def search_payload(
    queries: DataFrame, points: DataFrame, columns: list[str], limit: int = SEARCH_LIMIT, measured=None, vectors: bool = True, **options
) -> DataFrame:
    """``search`` with payload columns of every hit (at most queries x limit rows), and its vector unless ``vectors`` is false."""
    size = measured or measure(queries)
    hits = search(queries, points, limit, measured=size, **options)
    return attach(hits, points.select("point_id", *(["vector"] if vectors else []), *columns), at_most=size[0] * limit)


# ---- diversity rerank ----------------------------------------------------------


def greedy_picks(scores: np.ndarray, vectors: list, k: int, lam: float) -> list[int]:
    """Positions picked by maximal marginal relevance from one short candidate list.

    ``nearest`` is each candidate's largest similarity to the picks so far and
    starts at 0, so negative similarities never reward. Of equal values the first
    candidate wins.
    """
    n = len(scores)
    sims = np.zeros((n, n))
    for length, (where, m) in _matrix(vectors).items():
        if length:
            norms = np.sqrt((m * m).sum(axis=1))
            denominator = np.outer(norms, norms)
            with np.errstate(divide="ignore", invalid="ignore"):
                sims[np.ix_(where, where)] = np.where(denominator == 0, 0.0, (m @ m.T) / denominator)
    nearest, free, picks = np.zeros(n), np.ones(n, dtype=bool), []
    for _ in range(min(k, n)):
        value = np.where(free, lam * scores - (1 - lam) * nearest, -np.inf)
        best = int(value.argmax())
        picks.append(best)
        free[best] = False
        nearest = np.maximum(nearest, sims[:, best])
    return picks


def mmr_rerank(
    candidates: DataFrame, k: int = TOP_K, lam: float = MMR_LAMBDA, carry: list[str] | None = None
) -> DataFrame:
    """Greedy pick of ``k`` candidates per query: lam * score - (1 - lam) * nearest pick.

    ``candidates``: query_id, rank, point_id, score, vector. A query never has more
    candidates than the search limit, so one array holds them. Only scores and
    vectors go to Python, in Arrow batches; columns named in ``carry`` stay in the
    JVM row and travel with their candidate.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pick(scores: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series([greedy_picks(np.asarray(s, dtype=np.float64), list(v), k, lam) for s, v in zip(scores, vectors)])

    payload = F.struct(F.lit(0).alias("_"), *(carry or [])).alias("payload")
    lists = candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "point_id", "score", "vector", payload))).alias("c")
    )
    picked = lists.withColumn("_p", pick(F.col("c.score"), F.col("c.vector")))
    # the outer form keeps Spark from running the Python step again for a size filter
    rows = picked.select("query_id", "c", F.posexplode_outer("_p").alias("_pos", "_i")).filter(F.col("_i").isNotNull())
    chosen = F.col("c")[F.col("_i")]
    return rows.select(
        "query_id",
        (F.col("_pos") + 1).alias("mmr_rank"),
        chosen["point_id"].alias("point_id"),
        chosen["score"].alias("score"),
        *[chosen["payload"][name].alias(name) for name in carry or []],
    )


# ---- citations -----------------------------------------------------------------


def with_source(hits: DataFrame, sources: DataFrame, at_most: int | None = None) -> DataFrame:
    """Source metadata for every hit; hits without a source vanish. Texts of sources are not read.

    With a proven bound on the hits, their ids pick the few sources needed from
    the scan, so the registry is not shuffled.
    """
    meta = sources.select(
        "source_id",
        "title",
        "uri",
        "publisher",
        "license_info",
        F.col("retrieved_at").alias("source_retrieved_at"),
        F.col("source_version").alias("meta_version"),
        F.col("content_hash").alias("meta_hash"),
    )
    if at_most is not None and at_most <= BROADCAST_ROWS:
        meta = meta.join(F.broadcast(hits.select("source_id").distinct()), "source_id", "left_semi")
    return hits.hint("merge").join(meta, "source_id")  # stored hits are far smaller on disk than as rows: never broadcast


def citation_complete(hits: DataFrame) -> DataFrame:
    """Add ``reason`` (first missing field, null when complete), ``citation_hash`` and ``confidence``."""
    citation_hash = F.coalesce("content_hash", "meta_hash")

    def missing(col) -> Column:
        return F.coalesce(F.col(col), F.lit("")) == ""

    reason = (
        F.when(missing("chunk_text"), F.lit("chunk_text"))
        .when(missing("trust_level"), F.lit("trust_level"))
        .when(F.coalesce(citation_hash, F.lit("")) == "", F.lit("content_hash"))
        .when(missing("page_or_section"), F.lit("page_or_section"))
        .when(is_blank("title"), F.lit("title"))
        .when(is_blank("publisher"), F.lit("publisher"))
        .when(is_blank("license_info"), F.lit("license"))
    )
    return (
        hits.withColumn("reason", reason)
        .withColumn("citation_hash", citation_hash)
        .withColumn("confidence", confidence_of("trust_level"))
    )


def query_filters(queries: DataFrame, display: str = "display_subject") -> DataFrame:
    """Search clauses of a display subject: stored subject and allowed contexts.

    No subject means no clause. An unknown one raises: it must never switch the
    confession filter off.
    """
    unknown = F.col(display).isNotNull() & stored_subject(display).isNull()
    subject = F.when(
        unknown, F.raise_error(F.concat(F.lit("unknown display subject: "), F.col(display)))
    ).otherwise(stored_subject(display))
    return queries.withColumn("subject", subject).withColumn("contexts", search_contexts(display))

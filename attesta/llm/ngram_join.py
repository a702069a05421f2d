"""Near duplicates by word shingles: a Jaccard join filtered by prefixes under several global token orders.

If two sets are similar enough, then under any order of all shingles their first few share
one. Three orders are used. All put shingles that are frequent in the corpus last, so long
shared passages rarely reach a prefix, and differ by a seeded hash inside a frequency class.
The first order makes candidates by a join on prefix shingles and bounds the overlap by the
number shared; the others must share a prefix shingle too, before the whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.graph import components
from attesta.llm.words import long_column, mix, shingles, word_runs
from attesta.session import staged

WIDTH = 5
BIN_BITS = 18
ORDERS = 3
CHUNK = 4096
HUBS = 6
BROADCAST_IDS = 1_000_000
FACTS = "doc_id bigint, n bigint, node bigint, chunk int, counts binary"


def _bins(tokens: np.ndarray, order: int) -> np.ndarray:
    return ((tokens >> np.uint64(64 - BIN_BITS * (order + 1))) & np.uint64((1 << BIN_BITS) - 1)).astype(np.int64)


def _node(tokens: np.ndarray) -> np.ndarray:
    """A 64-bit name of a shingle set: documents with equal sets are one node of the join."""
    return mix(mix(np.append(tokens, np.uint64(len(tokens))) ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64))


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, hashes, bounds, _ in word_runs(texts):
        for i in range(len(bounds) - 1):
            yield first + i, np.unique(shingles(hashes[bounds[i] : bounds[i + 1]], WIDTH))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and node of every document, and at the end of a task its shingle counts by order and bin."""
    totals = np.zeros((ORDERS, 1 << BIN_BITS), dtype=np.int32)
    names = ["doc_id", "n", "node", "chunk", "counts"]
    for batch in batches:
        size, node = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.uint64)
        for row, tokens in _sets(batch.column("text")):
            size[row], node[row] = len(tokens), _node(tokens)
            for order in range(ORDERS):
                np.add.at(totals[order], _bins(tokens, order), 1)
        empty = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), long_column(node), *empty], names=names)
    if totals.any():
        parts = totals.reshape(-1, CHUNK)
        nulls = [pa.nulls(len(parts), pa.int64())] * 3
        chunks = pa.array(np.arange(len(parts), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*nulls, chunks, pa.array([p.tobytes() for p in parts], pa.binary())], names=names)


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, np.int64(0)) + np.frombuffer(counts, dtype=np.int32)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"]
        )


def _bin_ranks(facts: DataFrame) -> np.ndarray:
    """Ranks of the bin counts of each order: 3 * 2^18 numbers, however large the corpus is."""
    parts = facts.filter(F.col("chunk").isNotNull()).select("chunk", "counts").repartition(16, "chunk")
    counts = np.zeros(ORDERS << BIN_BITS, dtype=np.int64)
    for row in parts.mapInArrow(_sum_chunks, "chunk int, counts binary").collect():
        counts[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], dtype=np.int64)
    return np.stack([np.unique(c, return_inverse=True)[1].astype(np.uint32) for c in counts.reshape(ORDERS, -1)])


def _prefix(tokens: np.ndarray, ranks: np.ndarray, order: int) -> np.ndarray:
    """The shingles of a set that come first under an order; similar sets share one of them."""
    n = len(tokens)
    length = n - (4 * n + 4) // 5 + 1
    place = ranks[order][_bins(tokens, order)].astype(np.uint64)
    rank = (place << np.uint64(64 - BIN_BITS)) | (mix(tokens) >> np.uint64(BIN_BITS))
    first = np.argpartition(rank, length - 1)[:length]
    return tokens[first[np.argsort(rank[first])]]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), long_column(flat))


def _postings(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task; copies need no second posting
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            for _, own in _sets(batch.column("text")):
                if len(own) and (node := int(_node(own))) not in seen:
                    seen.add(node)
                    tokens.append(_prefix(own, ranks, 0))
                    nodes.append(np.full(len(tokens[-1]), node, dtype=np.uint64))
                    sizes.append(np.full(len(tokens[-1]), len(own), dtype=np.int32))
                    places.append(np.arange(len(tokens[-1]), dtype=np.int32))
            if tokens:
                numbers = [pa.array(np.concatenate(x)) for x in (sizes, places)]
                yield pa.RecordBatch.from_arrays(
                    [long_column(np.concatenate(tokens)), long_column(np.concatenate(nodes)), *numbers], names=["token", "node", "n", "at"]
                )

    return docs.select("text").mapInArrow(run, "token bigint, node bigint, n int, at int")


def _whole_sets(docs: DataFrame, facts: DataFrame, nodes: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Shingles, and prefixes under the other orders, of one document for each of the given nodes."""
    chosen = facts.filter(F.col("n") > 0).join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = staged(chosen.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct())
    small = ids.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s for _, s in _sets(batch.column("text")) if len(s)]
            if own:
                others = [_lists([_prefix(s, ranks, k) for s in own]) for k in (1, 2)]
                names = long_column(np.array([_node(s) for s in own], dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([names, _lists(own), *others], names=["node", "tokens", "second", "third"])

    made = rows.select("text").mapInArrow(run, "node bigint, tokens array<bigint>, second array<bigint>, third array<bigint>")
    return staged(made.dropDuplicates(["node"]))


# of sets of na and nb shingles, this many must be common
LEAST = "((4 * (na + nb) + 8) div 9)"


def _in_reach(x: str = "xa", y: str = "xb") -> Column:
    """Sizes that allow the similarity, and a shared shingle so early in both sets that enough can follow it."""
    fits = F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 4
    return fits & (F.col(x) <= F.col("na") - F.expr(LEAST)) & (F.col(y) <= F.col("nb") - F.expr(LEAST))


def _enough(shared: Column, seen: float = 1.0) -> Column:
    """Whether two sets share as many prefix shingles as the similarity needs.

    Shingles behind the later prefix end are common to both at most as often as one set has
    any, so the overlap is at most ``shared`` plus the larger rest of a set. Where ``shared``
    may miss some, ``seen`` is the part of them that is asked for.
    """
    rest = F.greatest(*[F.expr(f"(4 * {n} + 4) div 5 - 1") for n in ("na", "nb")])
    return shared >= (F.expr(LEAST) - rest) * seen


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that also share a prefix shingle under the other orders and whose sets are similar enough."""
    one = sets.select(*[F.col(c).alias(f"{c}_a") for c in sets.columns])
    two = sets.select(*[F.col(c).alias(f"{c}_b") for c in sets.columns])
    both = pairs.select(F.col("a").alias("node_a"), F.col("b").alias("node_b")).join(one, "node_a").join(two, "node_b")
    kept = both.filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    similar = common * 9 >= (F.size("tokens_a") + F.size("tokens_b")) * 4
    return kept.filter(similar).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Two documents link when their sets of 5-word shingles have 100 * intersection >=
    80 * union; shorter texts are one shingle; texts without words link with nothing.
    A component is named by its smallest id. Documents with equal sets are one node.
    Repeated rows get a row each. A row without an id joins the component of an equal set that
    has one; else it links with nothing and has a null component. An empty table gives no rows; extra columns
    are not read.

    Of a group of near copies not all pairs are made: the nodes of a prefix shingle first
    meet HUBS of them, half of these central ones, and only nodes that this leaves in different components are paired in
    full. No link between different components is lost that way.
    """
    rows = docs.select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    facts = staged(rows.mapInArrow(_facts, FACTS))
    ranks = _bin_ranks(facts)
    facts = facts.filter(F.col("chunk").isNull()).select("doc_id", "n", "node")
    postings = staged(_postings(rows, ranks).select("token", "node", "n", "at").distinct())
    # the least and the greatest node are combined before the shuffle, so a common shingle costs no task more
    ends = postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = staged(postings.join(ends.filter("lo <> hi").select("token"), "token", "left_semi"))

    # where a shingle comes early, little in the set is rarer: the centre of a group of near copies
    early = [F.col("at") if i < HUBS // 2 else F.lit(0) for i in range(HUBS)]
    order = [F.struct(e.alias("early"), F.xxhash64("node", F.lit(i)).alias("h"), "node", "n", "at") for i, e in enumerate(early)]
    hubs = [F.min(o).alias(f"h{i}") for i, o in enumerate(order)]
    each = F.array_distinct(F.array(*[F.struct(f"h{i}.node", f"h{i}.n", f"h{i}.at") for i in range(HUBS)]))
    chosen = shared.groupBy("token").agg(*hubs).select("token", F.explode(each).alias("hub"))
    star = shared.join(chosen, "token").filter(F.col("hub.node") != F.col("node"))
    turned = F.col("hub.node") > F.col("node")
    met = star.select(
        F.least("hub.node", "node").alias("a"),
        F.greatest("hub.node", "node").alias("b"),
        *[F.when(turned, F.col(c)).otherwise(F.col(f"hub.{c}")).alias(x) for c, x in (("n", "na"), ("at", "xa"))],
        *[F.when(turned, F.col(f"hub.{c}")).otherwise(F.col(c)).alias(x) for c, x in (("n", "nb"), ("at", "xb"))],
    )
    # not every shingle that two nodes share has one of them as hub, and two hubs meet twice
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"), F.max(_in_reach()).alias("near"))
    first = staged(counted.filter(F.col("near") & _enough(F.col("shared"), 0.3)).select("a", "b"))
    sets = _whole_sets(rows, facts, first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), ranks)
    links = staged(_verified(first, sets))
    groups = staged(components(links))

    named = shared.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    open_tokens = named.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y").select("token")
    rest = named.join(open_tokens, "token", "left_semi").select("token", "node", "n", "at", "group")
    rest = staged(rest)
    left = rest.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("xa"), F.col("group").alias("ga"))
    right = rest.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("xb"), F.col("group").alias("gb"))
    apart = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb"))
    crossing = left.join(right, "token").filter(_in_reach() & apart).select("a", "b", "na", "nb").distinct()
    fresh = crossing.join(first, ["a", "b"], "left_anti")
    heads = shared.groupBy("node").agg(F.collect_set("token").alias("tokens"))
    sides = fresh.join(heads.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(
        heads.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"
    )
    second = staged(sides.filter(_enough(F.size(F.array_intersect("ta", "tb")))).select("a", "b"))
    missing = second.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node", "left_anti")
    more = _whole_sets(rows, facts, missing, ranks)
    links = links.unionByName(_verified(second, sets.unionByName(more)))
    groups = staged(components(links))

    placed = staged(facts.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")))
    names = placed.filter(F.col("n") > 0).groupBy("group").agg(F.min("doc_id").alias("smallest"))
    return placed.join(names, "group", "left").select(
        F.col("doc_id").alias(id_),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
    )

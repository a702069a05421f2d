"""Benchmark decontamination: containment MinHash of short test items inside long documents.

Items and documents differ in size by orders of magnitude, so signatures of whole documents
would say nothing about a passage. The small side is sketched instead: items fall into size
classes, and each class keeps so many smallest shingle hashes of an item that a document
holding the required share of it holds a quarter of the sketch but for a chance below 1e-6.
Every shingle of every document is tried against the sketches; candidates are verified on
the words. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import staged

WIDTH = 5
SHARE = 0.8
SKETCH = 16
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words of a text in order, A-Z in lower case; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+"), "")


def _at(words: str, i: Column, width: int) -> list[Column]:
    return [F.get(F.col(words), i + k) for k in range(width)]


def _starts(words: str, width: int) -> Column:
    count = F.size(words) - width + 1
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _texts(words: str, width: Column, count: Column) -> Column:
    """The distinct runs of ``width`` words as texts."""
    runs = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(count > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def prepared_items(items: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct items with words: key, item_id, words, width (5, or all words of a shorter item), grams, size."""
    rows = items.select(F.col(item).alias("item_id"), word_list(F.col(text)).alias("words")).filter(F.size("words") > 0)
    rows = rows.filter(F.col("item_id").isNotNull()).distinct()
    width = F.least(F.size("words"), F.lit(WIDTH))
    grams = rows.withColumn("width", width).withColumn(
        "grams", _texts("words", F.col("width"), F.size("words") - F.col("width") + 1)
    )
    return grams.select(F.xxhash64("item_id", "words").alias("key"), "*", F.size("grams").alias("size"))


def _hashes(rows: DataFrame, keep: list[str], width: int) -> DataFrame:
    """One row per run of ``width`` words: its hash. The outer form keeps the words from being split per row."""
    runs = rows.select(*keep, "words", F.explode_outer(_starts("words", width)).alias("i")).filter(F.col("i").isNotNull())
    return runs.select(*keep, F.xxhash64(F.lit(width), *_at("words", F.col("i"), width)).alias("hash"))


def sketches(items: DataFrame, widths: list[int]) -> DataFrame:
    """(key, hash, width, least): the smallest hashes of each item, and how many a document must share.

    Classes of item size: up to 16 shingles all of them are kept, up to 256 sixteen, and
    twice as many for every further factor of 16.
    """
    parts = [_hashes(items.filter(F.col("width") == w), ["key", "width", "size"], w).distinct() for w in widths]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    kept = F.lit(SKETCH) * F.pow(2, F.greatest(F.ceil(F.log(16.0, F.col("size"))) - 2, F.lit(0)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("hash")))
    least = F.when(F.col("size") <= SKETCH, F.ceil(F.col("size") * SHARE - 1e-9)).otherwise(F.ceil(kept / 4))
    return ranked.filter(F.col("rank") <= kept).select("key", "hash", "width", least.cast("int").alias("least"))


def contaminated(docs: DataFrame, items: DataFrame, id_: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (id, item, item_shingles, shared, containment) of documents that hold at least 80 % of an item's shingles.

    A shingle is a run of five words (A-Z lower-cased), or all words of a shorter item. Items
    without words or id and documents without id are not compared; rows of one id count as
    one document; of several texts of one item the best contained counts. Repeated rows
    change nothing. Empty tables give no rows; extra columns are not read.
    """
    known = staged(prepared_items(items, item, item_text))
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # at most 1 to 5
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("body")).filter(F.col("id").isNotNull())
    words = rows.select("id", word_list(F.col("body")).alias("words"))
    small = known.count() <= BROADCAST_ROWS // SKETCH
    if not widths:
        return known.join(rows, F.lit(False)).select(
            F.col("id").alias(id_),
            F.col("item_id").alias(item),
            F.col("size").alias("item_shingles"),
            F.col("size").alias("shared"),
            F.lit(0.0).alias("containment"),
        )
    sketch = staged(sketches(known, widths))
    hits = []
    for width in widths:
        side = sketch.filter(F.col("width") == width).drop("width")
        hits.append(_hashes(words, ["id"], width).join(F.broadcast(side) if small else side, "hash").distinct())
    found = hits[0]
    for other in hits[1:]:
        found = found.unionByName(other)
    counted = found.groupBy("id", "key", "least").agg(F.count("*").alias("n")).filter(F.col("n") >= F.col("least"))
    candidates = staged(counted.select("id", "key"))
    ids = candidates.select("id").distinct()
    texts = rows.join(F.broadcast(ids) if candidates.count() <= BROADCAST_ROWS else ids, "id", "left_semi")
    pairs = texts.join(candidates, "id").join(known.select("key", "item_id", "grams", "width", "size"), "key")
    split = pairs.withColumn("words", word_list(F.col("body")))
    own = _texts("words", F.col("width"), F.size("words") - F.col("width") + 1)
    common = split.select("id", "key", "item_id", "size", F.explode(F.array_intersect(own, "grams")).alias("gram"))
    shared = common.groupBy("id", "item_id", "key", "size").agg(F.count_distinct("gram").alias("shared"))
    passed = shared.filter(F.col("shared") * 100 >= F.col("size") * int(SHARE * 100))
    best = passed.groupBy("id", "item_id").agg(
        F.max(F.struct((F.col("shared") / F.col("size")).alias("share"), "size", "shared")).alias("best")
    )
    return best.select(
        F.col("id").alias(id_),
        F.col("item_id").alias(item),
        F.col("best.size").alias("item_shingles"),
        F.col("best.shared").cast("int").alias("shared"),
        F.round("best.share", 6).alias("containment"),
    )

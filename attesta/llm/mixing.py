"""Mixing a corpus to target token shares by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import staged

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, MOST_ROUNDS, TOLERANCE = 4, 40, 1e-6
CELLS_PER_TASK = 200_000
BROADCAST_CELLS = 1_000_000
GRID = 256


def register(text: str) -> Column:
    """The form of a text, as its topic where a corpus names none: empty, table, shouting, marks, note, essay or prose."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.length(body)

    def share(characters: str) -> Column:
        return size - F.length(F.translate(body, characters, ""))

    return (
        F.when(size == 0, "empty")
        .when(share("|") * 50 >= size, "table")
        .when(share("#$%&*@^~") * 20 >= size, "marks")
        .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 5 >= size, "shouting")
        .when(size < 500, "note")
        .when(size >= 8000, "essay")
        .otherwise("prose")
    )


def _cell_id(columns: list[str]) -> Column:
    return F.xxhash64(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])


def token_cells(rows: DataFrame) -> DataFrame:
    """Documents and tokens of every combination of the dimensions that occurs and has tokens."""
    cells = rows.groupBy("cell", *DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    return cells.filter(F.col("tokens") > 0)


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a dimension: its token shares raised to ``power`` (below 1 lifts the rare values)."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("part"))
    total = sums.agg(F.sum("part")).first()[0] or 1.0
    return sums.select(F.col(dimension).alias("value"), (F.col("part") / F.lit(total)).alias("target"))


class Unreachable(ValueError):
    """Targets that no weights of the cells meet."""


def given_targets(cells: DataFrame, dimension: str, given: DataFrame) -> DataFrame:
    """Target shares of a dimension from a table (value, target): parts of their sum, each value once.

    Null is a value; values without a target get none of the mix. Raises ``Unreachable`` for negative or
    repeated targets, for a sum of 0, and for values with a target that no token has.
    """
    table = staged(given.select(F.col("value").cast("string").alias("value"), F.col("target").cast("double").alias("target")))
    total, least, n, distinct = table.agg(
        F.sum("target"), F.min("target"), F.count("*"), F.countDistinct(F.struct("value"))
    ).first()
    if not total or least < 0 or n != distinct:
        raise Unreachable(f"targets of {dimension}: each value once, none negative, some above 0")
    there = cells.select(F.col(dimension).cast("string").alias("_there")).distinct()
    lost = table.filter("target > 0").join(there, F.col("value").eqNullSafe(F.col("_there")), "left_anti").first()
    if lost is not None:
        raise Unreachable(f"targets of {dimension}: no tokens of {lost['value']!r}")
    return table.select("value", (F.col("target") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, float]]:
    """(cells with ``weight``, the largest relative error of each dimension's marginals).

    Weights are token shares with the target marginals, nearest in proportion to the observed ones.
    A round scales the cells of every value of each dimension in turn to its target. Rounds
    go on until no marginal is off by more than TOLERANCE of its target, or stop after
    MOST_ROUNDS with the marginals of the last dimension met. A value without a target gets
    weight 0. One row per cell; a task handles CELLS_PER_TASK of them, larger tables shuffle
    by value.
    """
    tasks = max(1, cells.count() // CELLS_PER_TASK)
    current = cells
    for name, target in targets.items():
        side = target.select(F.col("value").alias(f"v_{name}"), F.col("target").alias(f"t_{name}"))
        current = current.join(side, F.col(name).eqNullSafe(F.col(f"v_{name}")), "left").drop(f"v_{name}")
        current = current.fillna(0.0, [f"t_{name}"])
    weight = F.when(F.least(*[F.col(f"t_{n}") for n in targets]) > 0, F.col("tokens").cast("double")).otherwise(0.0)
    current = staged(current.withColumn("weight", weight))
    errors = {name: 0.0 for name in targets}
    for _ in range(0, MOST_ROUNDS, ROUNDS):
        step = current.coalesce(tasks)
        for _ in range(ROUNDS):
            for name in targets:
                have = F.sum("weight").over(Window.partitionBy(name))
                step = step.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"t_{name}") / have).otherwise(0.0))
        current = staged(step)
        off = []
        for name in targets:
            sums = current.coalesce(tasks).groupBy(name).agg(F.sum("weight").alias("w"), F.max(f"t_{name}").alias("t"))
            error = F.max(F.abs(F.col("w") / F.col("t") - 1)).alias("off")
            off.append(sums.filter("t > 0").agg(error).select(F.lit(name).alias("name"), "off"))
        worst = off[0]
        for other in off[1:]:
            worst = worst.unionByName(other)
        errors = {r["name"]: r["off"] or 0.0 for r in worst.collect()}
        if max(errors.values()) <= TOLERANCE:
            break
    return current.drop(*[f"t_{n}" for n in targets]), errors


def calibrate(cells: DataFrame, share: float) -> DataFrame:
    """Cells with ``probability`` in proportion to weight / tokens, at most 1, that keep ``share`` of all tokens.

    The factor is found on grids of GRID values, each inside one step of the last; only the
    sums of a grid leave the tasks. If no factor keeps that much, all documents of weighted
    cells have probability 1.
    """
    ratio = cells.filter("weight > 0").withColumn("ratio", F.col("weight") / F.col("tokens"))
    total, lowest = ratio.agg(F.sum("tokens"), F.min("ratio")).first()
    low, high = 0.0, 1.0 / lowest if lowest else 0.0
    goal = share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    if total and goal < total:
        for _ in range(4):
            step = (high - low) / GRID
            tried = ratio.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(GRID))))
            kept = F.sum(F.col("tokens") * F.least(F.lit(1.0), (F.col("i") * step + low) * F.col("ratio"))).alias("kept")
            reached = tried.groupBy("i").agg(kept).filter(F.col("kept") >= goal * (1 - 1e-12)).agg(F.min("i")).first()[0] or GRID
            low, high = low + (reached - 1) * step, low + reached * step
    found = F.least(F.lit(1.0), F.lit(high) * F.col("weight") / F.col("tokens"))
    return cells.withColumn("probability", F.coalesce(found, F.lit(0.0)))


def draw(seed: int, id_: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone (on the text where there is no id)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _facts(docs: DataFrame, topic: Column, id_: str, text: str, source: str, lang: str, seed: int, *keep: Column) -> DataFrame:
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return docs.select(
        *keep,
        F.col(id_).alias("id"),
        draw(seed, F.col(id_), F.col(text)).alias("draw"),
        F.col(source).alias("source"),
        F.col(lang).alias("lang"),
        topic.alias("topic"),
        F.size(words).cast("bigint").alias("tokens"),
    ).withColumn("cell", _cell_id(list(DIMENSIONS)))


Targets = dict[str, "float | DataFrame"]


def _fitted(facts: DataFrame, share: float, targets: Targets) -> tuple[DataFrame, float]:
    """((cell, weight, probability), to be joined to documents, broadcast where the counted cells are few; residual)."""
    cells = staged(token_cells(facts.select("cell", *DIMENSIONS, "tokens")))
    tables = {
        d: given_targets(cells, d, targets[d]) if isinstance(targets[d], DataFrame) else tempered_targets(cells, d, targets[d])
        for d in DIMENSIONS
    }
    raked, errors = rake(cells, tables)
    worst = max(errors, key=errors.get)
    if errors[worst] > TOLERANCE and any(isinstance(t, DataFrame) for t in targets.values()):
        raise Unreachable(f"targets of {worst} are missed by {errors[worst]:.2g} after {MOST_ROUNDS} rounds")
    fitted = staged(calibrate(raked, share).select("cell", "weight", "probability"))
    return (F.broadcast(fitted) if fitted.count() <= BROADCAST_CELLS else fitted), errors[worst]


def mix(docs: DataFrame, share: float, targets: Targets, topic: Column, id_: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", seed: int = 1) -> DataFrame:
    """One row per document: id, tokens, source, lang, topic, weight, probability, sampled, residual.

    ``targets`` says for source, lang and topic what token shares the mix is raked to: a table
    (value, target) of shares, or a power to which the observed shares are raised. ``weight`` is the
    target share of the document's cell, ``residual`` the largest relative error of a marginal. Given
    tables are met within TOLERANCE, or ``Unreachable`` names the dimension; powers may end with a larger residual
    where the cells that occur do not allow more. Documents are then
    sampled by probabilities calibrated to keep ``share`` of the tokens. ``topic`` is any column. Null is a value of
    its own in every dimension. Documents of a cell without tokens are not sampled.
    Repeated rows share their fate. An empty table gives no rows; extra columns are not read.
    """
    facts = staged(_facts(docs, topic, id_, text, source, lang, seed))
    fitted, residual = _fitted(facts, share, targets)
    joined = facts.join(fitted, "cell", "left").fillna(0.0, ["weight", "probability"])
    sampled = F.col("draw") < F.col("probability")
    return joined.select(
        F.col("id").alias(id_), "tokens", *DIMENSIONS, "weight", "probability", sampled.alias("sampled"), F.lit(residual).alias("residual")
    )


def sample(docs: DataFrame, share: float, targets: Targets, topic: Column, id_: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", seed: int = 1) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, all their columns kept.

    Nulls, repeated rows, targets and errors as there; of equal draws all rows stay or go. An empty table
    gives no rows.
    """
    facts = staged(_facts(docs, topic, id_, text, source, lang, seed))
    rows = _facts(docs, topic, id_, text, source, lang, seed, F.struct("*").alias("row")).select("row", "draw", "cell")
    return rows.join(_fitted(facts, share, targets)[0], "cell").filter("draw < probability").select("row.*")

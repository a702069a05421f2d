"""Registered queries: each pairs a DataFrame plan with the same answer in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from attesta.session import apply_settings, spread

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

LONG_TEXTS = ["documents", "pages"]


@dataclass
class View:
    """A table derived from the given ones. One SQL text serves both engines where it can;
    ``build`` replaces it on Spark where the array functions differ."""

    sql: str
    build: Callable[["Tables"], DataFrame] | None = None


VIEWS: dict[str, View] = {}


def view(name: str, sql: str, build: Callable[["Tables"], DataFrame] | None = None) -> None:
    VIEWS[name] = View(sql, build)


def names_in(sql: str) -> list[str]:
    """Tables and views a text refers to, in order of appearance."""
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def spark_sql(sql: str) -> str:
    """The shared text in Spark's spelling."""
    sql = re.sub(r"SHA256\(", "sha2_256(", sql)
    sql = re.sub(r"sha2_256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", sql)
    sql = sql.replace("LIST(", "array(").replace("EMPTY_STRINGS", "cast(array() AS array<string>)")
    sql = sql.replace("EMPTY_INTS", "cast(array() AS array<int>)")
    return re.sub(r"TIMESTAMP '", "TIMESTAMP_NTZ '", sql)


def duck_sql(sql: str) -> str:
    """The shared text in DuckDB's spelling."""
    sql = sql.replace("SHA256(", "sha256(").replace("LIST(", "list_value(")
    sql = sql.replace("{{", "{").replace("}}", "}")
    return sql.replace("EMPTY_STRINGS", "CAST([] AS VARCHAR[])").replace("EMPTY_INTS", "CAST([] AS INT[])")


@dataclass
class Tables:
    """The given tables and derived views of one data folder."""

    spark: SparkSession
    folder: str
    cache: dict[str, DataFrame] = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        if name not in self.cache:
            self.cache[name] = self._load(name)
        return self.cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in LONG_TEXTS else table
        made = VIEWS[name]
        if made.build is not None:
            return made.build(self)
        return self.sql(made.sql)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(spark_sql(text), **{n: self(n) for n in names_in(text)})


@dataclass
class Query:
    key: str
    plan: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register a plan under ``key``; ``sql`` refers to tables and views as ``{name}``."""

    def register(plan: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query(key, plan, sql)
        return plan

    return register


def runner(entry: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        apply_settings(spark)
        return entry.plan(Tables(spark, folder))

    return run


def _named(sql: str) -> str:
    """Placeholders as plain names (doubled braces are literal ones)."""
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", sql)


def oracle_text(sql: str) -> str:
    """A self-contained DuckDB statement: the views it needs become common tables."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name].sql)
                needed.append(name)

    visit(sql)
    plain = duck_sql(_named(sql)).strip()
    ctes = [f"{n} AS ({duck_sql(_named(VIEWS[n].sql)).strip()})" for n in needed]
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", plain)
    if own:
        plain = plain[own.end() :]
        return "WITH RECURSIVE " + ",\n".join([*ctes, plain])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + plain

"""Queries and their SQL. Inputs that both share are derived by the same SQL text in either engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: name -> SQL that Spark and DuckDB both read.
INPUTS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _named(sql: str, own: str = "") -> list[str]:
    return [n for n in [*TABLES, *INPUTS] if n != own and re.search(rf"\b(?:from|join)\s+{n}\b", sql)]


class Tables:
    """The tables of a folder and the inputs derived from them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.made:
            return self.made[name]
        if name in TABLES:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in INPUTS:
            found = self.sql(INPUTS[name], name)
        else:
            raise AttributeError(name)
        self.made[name] = found
        return found

    def sql(self, sql: str, own: str = "") -> DataFrame:
        used = _named(sql, own)
        for n in used:
            sql = re.sub(rf"\b(from|join)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in used})


def oracle(sql: str) -> str:
    """The SQL, with a CTE for each derived input that it needs."""
    needed: list[str] = []

    def add(text: str) -> None:
        for n in _named(text):
            if n in INPUTS and n not in needed:
                add(INPUTS[n])
                needed.append(n)

    add(sql)
    ctes = [f"{n} as ({INPUTS[n]})" for n in needed]
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {', '.join([*ctes, body[5:]])}"
    return f"with {', '.join(ctes)} {body}" if ctes else body


def query(name: str, sql: str | None = None):
    """Registers f(tables) -> DataFrame under a name, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def oracles() -> dict[str, str]:
    return {k: oracle(v) for k, v in ORACLES.items()}

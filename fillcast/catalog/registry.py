"""Registry of checked queries.

A query names its output columns with their kinds; from that list both the Spark projection
and the SQL projection are made, so the two sides always have the same names and types:
i = integer, f = float rounded to six digits, s = text, d = date as text, u = timestamp as
microseconds since the epoch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillcast.functions.columns import micros

# Means of short decimals often end exactly half-way between two rounded values, where
# engines round differently; this shift moves them off the half.
OFF_TIE = 1.3e-8

Build = Callable[[SparkSession, str], DataFrame]


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "i":
        out = c.cast("long")
    elif kind == "f":
        out = F.round(c.cast("double") + F.lit(OFF_TIE), 6)
    elif kind == "u":
        out = micros(c)
    else:
        out = c.cast("string")
    return out.alias(name)


def _sql_column(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "f":
        return f"round(CAST({q} AS DOUBLE) + {OFF_TIE}, 6) AS {q}"
    if kind == "u":
        return f"epoch_us({q}) AS {q}"
    return f"CAST({q} AS VARCHAR) AS {q}"


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def project(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_spark_column(n, k) for n, k in parse(spec)])


@dataclass(frozen=True)
class Query:
    name: str
    spec: str
    build: Build
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return project(self.build(spark, sf_dir), self.spec)


REGISTRY: dict[str, Query] = {}
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    """A named piece of check SQL other queries can build on."""
    PARTS[name] = (sql.strip(), needs)


def _with_clause(needs: tuple[str, ...]) -> str:
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for n in PARTS[name][1]:
                visit(n)
            done.append(name)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{PARTS[n][0]}\n)" for n in done) + "\n" if done else ""


def query(name: str, spec: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        text = None
        if sql is not None:
            columns = ", ".join(_sql_column(n, k) for n, k in parse(spec))
            text = f"{_with_clause(needs)}SELECT {columns}\nFROM (\n{sql.strip()}\n) AS answer"
        REGISTRY[name] = Query(name, spec, build, text)
        return build

    return register

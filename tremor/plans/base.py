"""Registration of queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremor.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql_uniform(text: str) -> str:
    """DuckDB text of a number inside (0, 1) by a digest of ``text``, as ``inversion.uniform`` draws it."""
    digits = f"list_transform(range(1, 13), lambda z: CAST(instr('0123456789abcdef', substr(md5({text}), CAST(z AS INT), 1)) - 1 AS DOUBLE))"
    return f"(list_reduce(list_prepend(CAST(0 AS DOUBLE), {digits}), lambda s, x: s * 16 + x) + 0.5) / 281474976710656"


def query(sql: str | None = None):
    """Register a function of named views, given by its parameter names, under its own name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(fixtures.view(spark, sf_dir, n) for n in names))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = fixtures.oracle(sql)
        return f

    return add

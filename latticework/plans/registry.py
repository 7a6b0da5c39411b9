"""Collects the queries of the plan modules: name -> callable, name -> DuckDB SQL.

A query is registered with its columns and kinds ("idx:l v:d": l long, d double, s string,
b boolean). The Spark result and the SQL are both cast to these; doubles are rounded to six
digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
_SQL = {"l": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}
_SPARK = {"l": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}


def query(name: str, columns: str, sql: str | None = None, base: str = ""):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""
    kinds = [c.split(":") for c in columns.split()]

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, sf_dir):
            return f(spark, sf_dir).select(*[_SPARK[k](F.col(c)).alias(c) for c, k in kinds])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"{base}\nSELECT {', '.join(_SQL[k].format(c) + ' AS ' + c for c, k in kinds)} FROM (\n{sql.strip()}\n)"
        return f

    return add


from latticework.plans import catalog  # noqa: E402,F401  registers its queries

"""Registry of the runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, bigint: Sequence[str] = (), double: Sequence[str] = (),
          filled: Sequence[str] = (), shown: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Registers a query with its SQL.

    The rest makes both sides' values comparable without guessing types: `bigint` and `double` cast
    columns, `filled` writes -1 for a null number, `shown` writes a nullable flag as text.
    """

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({
                **{c: F.col(c).cast("bigint") for c in bigint}, **{c: F.col(c).cast("double") for c in double},
                **{c: F.coalesce(F.col(c), F.lit(-1)) for c in filled},
                **{c: F.coalesce(F.col(c).cast("string"), F.lit("unset")) for c in shown}}) \
                if bigint or double or filled or shown else df

        QUERIES[name] = run
        if sql is not None:
            casts = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in bigint] + \
                [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in double] + \
                [f'coalesce("{c}", -1) AS "{c}"' for c in filled] + \
                [f"coalesce(CAST(\"{c}\" AS VARCHAR), 'unset') AS \"{c}\"" for c in shown]
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return fn

    return add

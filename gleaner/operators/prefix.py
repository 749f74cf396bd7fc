"""Running totals and ranks inside groups of any size.

A plain window puts a whole group in one task. Here each group is cut into blocks
along its order: block totals are summed first (partial aggregates, few rows), then
every block is numbered on its own and shifted by what came before it.
`block` columns must rise with `order`; together with the group keys they bound what
one task sorts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], block: list[str], order: list[str],
                  measure: Column, out: str) -> DataFrame:
    """Adds `out`: inclusive running sum of `measure` per group in `order`."""
    totals = (df.groupBy(*keys, *block).agg(F.sum(measure).alias("_in_block")))
    before = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, *block]
    shifts = totals.select(*[F.col(n).alias(f"_shift_{n}") for n in names],
                           F.sum("_in_block").over(before).alias("_before"))
    within = (Window.partitionBy(*keys, *block).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = F.sum(measure).over(within)
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_shift_{n}")) for n in names])
    return (df.withColumn("_within", summed)
            .join(shifts, same)
            .withColumn(out, F.when(F.col("_before").isNull(), F.col("_within"))
                        .otherwise(F.col("_before") + F.col("_within")))
            .drop("_within", "_before", *[f"_shift_{n}" for n in names]))


def running_rank(df: DataFrame, keys: list[str], block: list[str], order: list[str],
                 out: str = "rank") -> DataFrame:
    """Adds `out`: 1-based position of the row in its group."""
    return running_total(df, keys, block, order, F.lit(1), out).withColumn(out, F.col(out).cast("bigint"))


def attach(df: DataFrame, small: DataFrame, keys: list[str], most: int = 100_000, salts: int = 32) -> DataFrame:
    """`df` with the columns of `small`, which has one row per key: sent to the rows while it has at most `most` rows, else joined
    with every key cut into `salts` pieces, so that a hot key is many tasks."""
    if small.limit(most + 1).count() <= most:
        return df.join(F.broadcast(small), keys)
    pieces = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(salts)).cast("int"))
    return dealt.join(pieces, [*keys, "_salt"]).drop("_salt")

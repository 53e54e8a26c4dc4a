"""Several exact distinct counts in one pass, without a copy of the rows for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_counts(df: DataFrame, keys: list[str], levels: dict[str, list[str]], sums: dict[str, Column]) -> DataFrame:
    """keys, the sums (of whole numbers over rows), and for each level the number of its distinct values.

    Levels go from the outermost to the innermost and nest: a level's values are told apart by its own columns and
    those of the levels before it, so an encounter under two subjects counts as two. Rows are collapsed once to the innermost level;
    every level outwards is a further, smaller grouping of the one before, with its partial sums on the map side.
    Null counts as one value; an empty table gives an empty result.
    """
    paths, path = [], [*keys]
    for columns in levels.values():
        paths.append(path)
        path = [*path, *columns]
    out = df.groupBy(*path).agg(*[F.sum(x.cast("bigint")).alias(name) for name, x in sums.items()])
    have = [*sums]
    for name, outer in reversed(list(zip(levels, paths, strict=True))):
        out = out.groupBy(*outer).agg(F.count(F.lit(1)).alias(name), *[F.sum(c).alias(c) for c in have])
        have.append(name)
    return out

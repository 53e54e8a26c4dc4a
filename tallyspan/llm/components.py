"""Connected components by contraction, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, component (the smallest node that links reach) for every node with a link; edges: a, b.

    In each round a node hooks to its neighbour, or stays itself, whichever has the smallest hash of that
    round; the links are then drawn between what nodes hooked to. Links shrink by a constant factor in the
    mean, so the number of rounds grows with the logarithm of the longest chain. Hubs are aggregated on the
    map side and joined from written tables, which Spark may split.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = written(edges.select(low, high).filter("a < b").distinct(), folder, "links-0")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        k = len(maps)
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), "v")).alias("m"))
        hooked = F.when(F.col("m.h") < F.xxhash64("u", F.lit(k)), F.col("m.v")).otherwise(F.col("u"))
        maps.append(written(least.select("u", hooked.alias("p")), folder, f"hooks-{k}"))
        a, b = (maps[k].select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        drawn = links.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        links = written(drawn.filter("a < b").distinct(), folder, f"links-{k + 1}")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for hooks in maps[1:]:
        found = found.join(hooks.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    found = written(found, folder, "roots")
    least = written(found.groupBy("root").agg(F.min("node").alias("component")), folder, "least")
    return written(found.join(least, "root").select("node", "component"), folder, "components")

"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least t lie within sqrt(2 - 2t) of each other. Vectors are turned to
their principal axes, sorted by the cells of a grid of that width on the leading axes, and cut into blocks
of the sequence. Pairs of sequence intervals are joined recursively: intervals of 16 times fewer blocks at
each level, and only pairs whose bounding boxes on the leading axes lie within the width go on. Surviving
pairs of blocks are gathered in tiles, the pairs of two stripes of up to `TILE` blocks: a block is sent once
to each tile that needs it, in the vectors' own precision, and meets its partners there, where the recursion goes on
down to small matrix products. A stripe is a sixteenth of all blocks, so up to 16 * TILE blocks the bytes sent grow in
proportion to the vectors; beyond, a stripe's bytes are bounded (`TILE_BYTES`) and they grow with the surviving tiles.
A task emits the number of links of each vector and a spanning forest of the links, never the links themselves.

Vectors of more than `MOST_AXES` components are turned to random axes first, of which the principal ones are
sought, so the sums that reach the driver are bounded. Any axes at right angles keep the result exact.

Vectors with equal components are one node with a weight from the start.

Vectors of different lengths never link; each length is joined on its own, one after the other.

Edge cases: null vectors, zero vectors and vectors with null or non-finite components link with nothing:
n_links 0, component_id = vec_id, kept. Rows with a null vec_id too, with a null component_id. Rows that repeat a vec_id and its vector count as several vectors under one id. An empty
table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_folder, table, written
from .components import components

LEADING, BLOCK, FAN, LEAF = 8, 2048, 16, 256
STRIPES, TILE, TILE_BYTES, MOST_AXES = 16, 64, 48_000_000, 128
BLOCKS_A_SHARD = 64


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column whose rows all have `size` values, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def precision_of(kind: str) -> type:
    """The precision that holds the components of a list column without loss."""
    return np.float32 if kind == "array<float>" else np.float64


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large and very small components neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def axes(vectors: DataFrame, size: int, leading: int) -> tuple[np.ndarray, int]:
    """Leading principal axes, and the number of vectors: sums of products are added up by Spark, MOST_AXES ** 2 numbers at most."""
    wide = np.eye(size)
    if size > MOST_AXES:
        wide = np.linalg.qr(np.random.default_rng(5).normal(size=(size, MOST_AXES)))[0]
    k = wide.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                rows = np.hstack([unit(matrix(batch.column("v"), size)) @ wide, np.ones((batch.num_rows, 1))])
                total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size, dtype=np.int32), "s": total.ravel()})

    sums = vectors.select("v").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros((k + 1) ** 2)
    total[sums.i.to_numpy()] = sums.s.to_numpy()
    total = total.reshape(k + 1, k + 1)
    n = round(total[-1, -1])
    mean = total[-1, :-1] / max(n, 1)
    _, found = np.linalg.eigh(total[:-1, :-1] / max(n, 1) - np.outer(mean, mean))
    return wide @ found[:, ::-1][:, :leading], n


def blocks(vectors: DataFrame, size: int, basis: np.ndarray, n: int, width: float, folder: str, block: int) -> DataFrame:
    """Blocks of the grid order: idx, ids, weights, vectors, lo, hi (box on the leading axes)."""

    kind = vectors.schema["v"].dataType.simpleString()
    precision = precision_of(kind)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(unit(matrix(batch.column("v"), size)) @ basis / width).astype(np.int32) if batch.num_rows else np.zeros((0, basis.shape[1]), np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)), pa.array(at.ravel()))
            yield batch.append_column("cell", flat)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, k, held = TaskContext.get().partitionId(), 0, []

        def block_of(rows: pa.RecordBatch) -> pa.RecordBatch:
            v = matrix(rows.column("v"), size)
            at = unit(v) @ basis
            ids, weights = rows.column("id").to_numpy(), rows.column("w").to_numpy()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "k": pa.array([k], pa.int64()), "ids": [ids.tobytes()], "weights": [weights.tobytes()], "vectors": [v.astype(precision).tobytes()], "lo": [at.min(0).tolist()], "hi": [at.max(0).tolist()]})

        for batch in batches:
            while batch.num_rows:
                room = block - sum(x.num_rows for x in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(min(room, batch.num_rows))
                if sum(x.num_rows for x in held) == block:
                    yield block_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    k, held = k + 1, []
        if held:
            yield block_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    parts = max(min(partitions(vectors.sparkSession), -(-n // block)), -(-n // (block * BLOCKS_A_SHARD)), 1)
    ordered = vectors.mapInArrow(cells, f"id bigint, w bigint, v {kind}, cell array<int>").repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")
    made = ordered.select("id", "w", "v").mapInArrow(cut, "shard bigint, k bigint, ids binary, weights binary, vectors binary, lo array<double>, hi array<double>")
    made = written(made, folder, "blocks")
    # One row a shard, so this window over all of them is small; it numbers the blocks without a gap.
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = made.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("start"))
    return made.join(F.broadcast(written(starts, folder, "block-starts")), "shard").withColumn("idx", F.col("start") + F.col("k")).drop("shard", "start", "k")


def near_blocks(boxes: DataFrame, width: float, top: int) -> DataFrame:
    """i <= j: pairs of blocks whose boxes lie within width, found level by level from one root pair."""
    levels = -(-max(1, top).bit_length() // (FAN.bit_length() - 1))
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"))
    for level in range(levels - 1, -1, -1):
        idx = F.floor(F.col("idx") / (FAN**level))
        at_level = boxes.select(idx.alias("idx"), F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "x")).groupBy("idx", "d").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
        at_level = at_level.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("d", "lo", "hi"))).alias("box"))
        a, b = (at_level.select(F.col("idx").alias(c), F.col("box").alias(f"box_{c}")) for c in "ij")
        child = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + (FAN - 1))).alias(c)
        pairs = pairs.select(child("i"), "j").select("i", child("j")).filter("i <= j")
        gap = F.aggregate(F.zip_with("box_i", "box_j", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
        pairs = pairs.join(a, "i").join(b, "j").filter(gap <= width * width * (1 + 1e-9)).select("i", "j")
    return pairs


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a bipartite link matrix, as (row, column) pairs."""
    rows, columns, out = near.any(1), near.any(0), []
    while rows.any():
        frontier = np.array([int(rows.argmax())])
        rows[frontier] = False
        while len(frontier):
            reached = np.flatnonzero(columns & near[frontier].any(0))
            out += zip(frontier[near[np.ix_(frontier, reached)].argmax(0)].tolist(), reached.tolist(), strict=True)
            columns[reached] = False
            onward = np.flatnonzero(rows & near[:, reached].any(1))
            out += zip(onward.tolist(), reached[near[np.ix_(onward, reached)].argmax(1)].tolist(), strict=True) if len(reached) else []
            rows[onward] = False
            frontier = onward
    return out


class BlockJoin:
    """Joins two blocks recursively; counts weighted links and gathers forest edges."""

    def __init__(self, least: float, basis: np.ndarray, precision: type):
        self.least, self.basis, self.precision = least, basis, precision
        self.width = np.sqrt(2 - 2 * least) * (1 + 1e-9)

    def load(self, row: dict) -> tuple:
        raw = np.frombuffer(row["vectors"], self.precision).reshape(-1, len(self.basis)).astype(np.float64)
        u = unit(raw)
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64), u, u @ self.basis

    def join(self, a: tuple, b: tuple, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        self.a, self.b, self.same = a, b, same
        self.na, self.nb, self.edges = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64), []
        self._part(0, len(a[0]), 0, len(b[0]))
        return self.na, self.nb, self.edges

    def _part(self, i: int, i2: int, j: int, j2: int) -> None:
        if i >= i2 or j >= j2 or self.same and j2 <= i:
            return
        pa_, pb = self.a[3][i:i2], self.b[3][j:j2]
        gap = np.maximum(0, np.maximum(pa_.min(0) - pb.max(0), pb.min(0) - pa_.max(0)))
        if gap @ gap > self.width**2:
            return
        if max(i2 - i, j2 - j) > LEAF:
            m, n = (i + i2) // 2, (j + j2) // 2
            for x in ((i, m), (m, i2)) if i2 - i > LEAF else ((i, i2),):
                for y in ((j, n), (n, j2)) if j2 - j > LEAF else ((j, j2),):
                    self._part(*x, *y)
            return
        near = self.a[2][i:i2] @ self.b[2][j:j2].T >= self.least
        if self.same:
            near &= np.arange(j, j2)[None, :] > np.arange(i, i2)[:, None]
        if near.any():
            self.na[i:i2] += near @ self.b[1][j:j2]
            self.nb[j:j2] += self.a[1][i:i2] @ near
            self.edges += [(int(self.a[0][i + r]), int(self.b[0][j + c])) for r, c in forest(near)]


def tile_links(pairs: DataFrame, held: DataFrame, least: float, basis: np.ndarray, precision: type, side: int) -> DataFrame:
    """a, b, n: counts of links (b null) and forest edges (n 0) of all pairs of blocks, tile by tile of side * side blocks."""
    corner = lambda c: F.floor(F.col(c) / side).alias(c[0] + "_tile")
    tiles = pairs.select(corner("i"), corner("j"), "i", "j")
    keys = ["i_tile", "j_tile"]
    sent = tiles.select(*keys, F.col("i").alias("place")).unionByName(tiles.select(*keys, F.col("j").alias("place"))).distinct()

    def links(joiner: BlockJoin, tile: tuple[int, int], rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for x in rows:
            if x["place"] // side != tile[0]:
                continue
            a = joiner.load(x)
            for y in rows:
                if y["place"] // side != tile[1] or y["place"] < x["place"]:
                    continue
                gap = np.maximum(0, np.maximum(np.subtract(x["lo"], y["hi"]), np.subtract(y["lo"], x["hi"])))
                if gap @ gap > joiner.width**2:
                    continue
                same = x["place"] == y["place"]
                b = a if same else joiner.load(y)
                na, nb, edges = joiner.join(a, b, same)
                some = [(ids[m], counts[m]) for ids, counts in ((a[0], na), (b[0], nb)) for m in [counts > 0]]
                e = np.array(edges, np.int64).reshape(-1, 2)
                ids, counts = (np.concatenate([x[c] for x in some]) for c in (0, 1))
                left = np.concatenate([ids, e[:, 0]])
                right = pa.array(np.concatenate([np.zeros(len(ids), np.int64), e[:, 1]]), mask=np.arange(len(left)) < len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(left), right, pa.array(np.concatenate([counts, np.zeros(len(e), np.int64)]))], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, tile, rows = BlockJoin(least, basis, precision), None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["i_tile"], row["j_tile"]) != tile:
                    if rows:
                        yield from links(joiner, tile, rows)
                    tile, rows = (row["i_tile"], row["j_tile"]), []
                rows.append(row)
        if rows:
            yield from links(joiner, tile, rows)

    full = sent.join(held.withColumnRenamed("idx", "place"), "place").repartition(*keys).sortWithinPartitions(*keys, "place")
    return full.mapInArrow(run, "a bigint, b bigint, n bigint")


def linked_nodes(rows: DataFrame, size: int, least: float, leading: int, block: int, folder: str) -> DataFrame:
    """v, n_links, component_id of every distinct vector of rows (vec_id, v), all of one length."""
    nodes = written(rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")).select("id", "w", "v"), folder, "nodes")
    basis, n = axes(nodes, size, min(leading, size))
    held = blocks(nodes, size, basis, n, float(np.sqrt(2 - 2 * least)), folder, block)
    boxes = held.select("idx", "lo", "hi")
    top = held.agg(F.max("idx")).first()[0]
    pairs = written(near_blocks(boxes, float(np.sqrt(2 - 2 * least)), top), folder, "block-pairs")
    precision = precision_of(nodes.schema["v"].dataType.simpleString())
    bytes_each = block * size * np.dtype(precision).itemsize
    side = int(max(1, min(-(-(top + 1) // STRIPES), TILE, TILE_BYTES // bytes_each)))
    found = written(tile_links(pairs, held, least, basis, precision, side), folder, "links")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comps = components(found.filter("b IS NOT NULL").select("a", "b"), folder)
    facts = nodes.join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    return written(facts.select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), folder, "facts")


def similar(vectors: DataFrame, least: float = 0.95, leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    counts = rows.filter(good).groupBy(F.size("v").alias("size")).count().filter("count > 1").orderBy("size").collect()
    sizes = [r["size"] for r in counts]
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = good & F.size("v").isin(sizes)
    found = [linked_nodes(rows.filter(good & (F.size("v") == size)), size, least, leading, block, f"{folder}/{size}") for size in sizes]
    facts = reduce(DataFrame.unionByName, found)
    linked = rows.filter(good).join(facts, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    return similar(table(spark, sf_dir, "embeddings"))

"""Ranked lexical search of many queries at once by a dual tree: a hierarchy over items and one over documents.

A document's coordinate at a term is its saturated, length-normalised frequency; an item's is the term's weight.
Every node of either hierarchy holds the maximum of each coordinate beneath it. The product of an item node and a
document node bounds every score between the two, so where it is less than the weakest kth score of the node's
items, the whole pair is left out, exactly. Equal scores are never left out, so ties are decided by doc_id.

Documents are read twice: once to find term frequencies within the items' vocabulary (written, with the corpus
counts taken from that table), once more as vectors. A task takes them in chunks of `chunk` documents, builds the
tree of each chunk and keeps the k best of every item, so its memory doesn't grow. A first search over a bounded
sample gives every item a score that k documents reach already; it makes the bounds sharp from the start and
changes no result. Items go by rounds of about `items_a_round`, whose vectors are what is broadcast.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased. All
numbers are integers below 2**53, so sums in doubles are exact.

Edge cases: null and empty texts have no term and are never found; items without a term, or whose terms no
document holds, have no row. Every row of either table counts on its own, so repeated documents rank one after
the other and a repeated item_id has its ranks once a row. A null doc_id comes after all others of its score.
Empty tables give an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, shared_folder, slices, table, text_buffers, written
from .words import LOWER, hashes, spans

TOP, LEAF, FAN, CHUNK, SAMPLE, ITEMS_A_ROUND = 10, 32, 8, 8192, 20_000, 256
#: Bytes between terms, and the constants of the score.
BETWEEN = np.array([b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
GAIN, SATURATION, LENGTH_PERCENT = 1_000_000_000, 8, 90
NULL_ID = np.iinfo(np.int64).max


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts; begin, end, row and hash of every term."""
    data, offsets = text_buffers(texts)
    data = LOWER[data]
    begin, end, row = spans(data, offsets, BETWEEN)
    return data, begin, end, row, hashes(data, begin, end)


def vocabulary(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted hashes of all terms of the items, and for each item the places of its own in them."""
    _, _, _, row, h = terms(pa.array(texts, pa.string()))
    known, place = np.unique(h, return_inverse=True)
    return known, [np.unique(place[row == k]) for k in range(len(texts))]


def vectors(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), ids and counts of the known terms, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, _, row, h = terms(part.column("text"))
                n = np.bincount(row, minlength=part.num_rows).astype(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                keys, counts = np.unique(row[hit] * max(len(known), 1) + at[hit], return_counts=True)
                own = np.bincount(keys // max(len(known), 1), minlength=part.num_rows) if len(keys) else np.zeros(part.num_rows, np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32())
                ids, tf = pa.array(keys % max(len(known), 1), pa.int32()), pa.array(counts, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, tf)], names=["doc_id", "n", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, counts array<int>")


def item_matrix(places: list[np.ndarray], df: np.ndarray, n_docs: int) -> np.ndarray:
    """A row for each item: the weight of each of its terms."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.float64)
    out = np.zeros((len(places), len(df)))
    for k, own in enumerate(places):
        out[k, own] = weight[own]
    return out


class ItemTree:
    """Items in the order of their heaviest terms; leaves of `leaf` items, nodes above them of `fan` leaves."""

    def __init__(self, items: np.ndarray, leaf: int = 4, fan: int = 4):
        self.items, order = items, np.argsort(items.argmax(1), kind="stable")
        self.leaves = [order[k : k + leaf] for k in range(0, len(order), leaf)]
        self.nodes = [np.arange(k, min(k + fan, len(self.leaves))) for k in range(0, len(self.leaves), fan)]
        self.leaf_max = np.array([items[x].max(0) for x in self.leaves])
        self.node_max = np.array([self.leaf_max[x].max(0) for x in self.nodes])


class Best:
    """The k best documents of every item so far, and the score below which none can enter."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.weakest = k, floor.astype(np.float64).copy()
        self.scores = [np.zeros(0, np.int64) for _ in floor]
        self.ids = [np.zeros(0, np.int64) for _ in floor]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        take = (scores >= self.weakest[item]) & (scores > 0)
        if not take.any():
            return
        s, d = np.concatenate([self.scores[item], scores[take].astype(np.int64)]), np.concatenate([self.ids[item], ids[take]])
        first = np.lexsort((d, -s))[: self.k]
        self.scores[item], self.ids[item] = s[first], d[first]
        if len(first) == self.k:
            self.weakest[item] = max(self.weakest[item], s[first[-1]])


def search_chunk(doc_ids: np.ndarray, at: np.ndarray, ids: np.ndarray, gain: np.ndarray, tree: ItemTree, best: Best) -> int:
    """Search one chunk of documents (rows at[i]:at[i + 1] of ids and gain); returns how many scores were computed."""
    n, width = len(doc_ids), tree.items.shape[1]
    heaviest, row = tree.items.max(0), np.repeat(np.arange(n), np.diff(at))
    leading = np.full(n, -1)
    order = np.lexsort((heaviest[ids] * gain, row))
    some = np.flatnonzero(np.diff(at))
    leading[some] = ids[order[at[some + 1] - 1]]
    place = np.argsort(leading, kind="stable")
    of = np.empty(n, np.int64)
    of[place] = np.arange(n)
    leaf_of = of[row] // LEAF
    n_leaves = -(-n // LEAF)
    leaf_max = np.zeros((n_leaves, width), np.float32)
    np.maximum.at(leaf_max, (leaf_of, ids), gain)
    by_leaf = np.argsort(leaf_of, kind="stable")
    cuts = np.searchsorted(leaf_of[by_leaf], np.arange(n_leaves + 1))
    tried = 0
    for top in range(0, n_leaves, FAN):
        inner = np.arange(top, min(top + FAN, n_leaves))
        maxima = leaf_max[inner].astype(np.float64)
        bound = tree.node_max @ maxima.max(0)
        live = [x for k, x in enumerate(tree.nodes) if bound[k] > 0 and bound[k] >= min(best.weakest[tree.leaves[y]].min() for y in x)]
        if not live:
            continue
        groups = np.concatenate(live)
        bounds = tree.leaf_max[groups] @ maxima.T
        for j, leaf in enumerate(inner):
            near = [tree.leaves[g] for k, g in enumerate(groups) if bounds[k, j] > 0 and bounds[k, j] >= best.weakest[tree.leaves[g]].min()]
            if not near:
                continue
            near = np.concatenate(near)
            single = tree.items[near] @ maxima[j]
            near = near[(single > 0) & (single >= best.weakest[near])]
            if not len(near):
                continue
            entries = by_leaf[cuts[leaf] : cuts[leaf + 1]]
            columns, column = np.unique(ids[entries], return_inverse=True)
            members = place[leaf * LEAF : (leaf + 1) * LEAF]
            exact = np.zeros((len(columns), len(members)))
            exact[column, of[row[entries]] - leaf * LEAF] = gain[entries]
            scores = tree.items[np.ix_(near, columns)] @ exact
            tried += scores.size
            for k, item in enumerate(near):
                best.add(item, scores[k], doc_ids[members])
    return tried


def search(found: DataFrame, items: np.ndarray, floor: np.ndarray, n_docs: int, n_terms: int, k: int, chunk: int = CHUNK) -> DataFrame:
    """item (row of items), doc_id, score: of every task the k best documents of each item with a score above 0."""
    shared = found.sparkSession.sparkContext.broadcast((items, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = shared.value
        tree, best = ItemTree(items), Best(floor, k)

        def flush(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            n = rows["n"].to_numpy()
            own = rows["ids"].combine_chunks()
            at = own.offsets.to_numpy().astype(np.int64)
            at, ids, tf = at - at[0], own.flatten().to_numpy(), rows["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
            length = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // n_terms
            gain = (GAIN * tf) // (1000 * tf + SATURATION * np.repeat(length, np.diff(at)))
            search_chunk(rows["doc_id"].fill_null(NULL_ID).to_numpy(), at, ids, gain.astype(np.float32), tree, best)

        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                if held + part.num_rows > chunk:
                    flush(parts)
                    parts, held = [], 0
                parts.append(part)
                held += part.num_rows
        if parts:
            flush(parts)
        item = np.repeat(np.arange(len(items)), [len(x) for x in best.ids])
        ids = np.concatenate([np.zeros(0, np.int64), *best.ids])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, mask=ids == NULL_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *best.scores]))], names=["item", "doc_id", "score"])

    return found.filter(F.size("ids") > 0).mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """rank (from 1): the k first of each item by falling score, then doc_id, null last."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, sample: int = SAMPLE, chunk: int = CHUNK, items_a_round: int = ITEMS_A_ROUND) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every row of items (item_id, text)."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    numbered = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("number")), folder, "items")
    # Rounds are dealt by hash, so their sizes differ a little; the bound on what is broadcast holds about.
    rounds = -(-numbered.count() // items_a_round)
    out = None
    for r in range(rounds):
        rows = numbered.filter(F.pmod(F.xxhash64("number"), F.lit(rounds)) == r).collect()
        if not rows:
            continue
        known, places = vocabulary([x.text for x in rows])
        found = written(vectors(docs, known), folder, f"vectors-{r}")
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(known), np.int64)
        for x in found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect():
            df[x.id] = x.df
        matrix, floor = item_matrix(places, df, n_docs), np.zeros(len(rows), np.int64)
        seed = ranked(search(bounded_sample(found, "doc_id", sample), matrix, floor, n_docs, n_terms, k, chunk), k)
        for x in seed.filter(F.col("rank") == k).collect():
            floor[x.item] = x.score
        hits = written(search(found, matrix, floor, n_docs, n_terms, k, chunk), folder, f"hits-{r}")
        names = spark.createDataFrame([(j, x.item_id) for j, x in enumerate(rows)], f"item bigint, item_id {items.schema['item_id'].dataType.simpleString()}")
        own = ranked(hits, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = own if out is None else out.unionByName(own)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item: item_id, rank, doc_id, score."""
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT sum(CASE WHEN len(ts) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
i AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
tf AS (SELECT doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3, ts),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY 1),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

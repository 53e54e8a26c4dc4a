"""MinHash near-deduplication by an inverted join over signature coordinates.

Every document has `coordinates` minimum hashes of its distinct five-word shingles. A posting (coordinate,
value) holds the documents that share it. Two documents with `matches` equal coordinates or more share at
least one posting among the `coordinates - matches + 1` rarest of either, so only these are posted (the
prefix), and postings of one document are dropped first: a text like no other posts nothing.

Collisions are counted in two passes. First every document is held against the document it shares most
prefix postings with among the smallest ids of its postings; whole shingle sets confirm the link. Then
postings whose members lie in one component already are skipped, since a further link changes nothing, and
in the others every pair of different components is counted again on a longer signature of one byte for each
coordinate, made for these documents alone, and what passes is confirmed on the whole sets. Large postings
are dealt into blocks of about `block` members, so no task gets a whole one, and members of a posting's
largest component meet only the others; a pair is tried in the first
posting that it shares and nowhere else, and pairs that don't match are never emitted. Documents with equal
shingle sets are one class from the start, and only the class's smallest doc_id takes part.

At a similarity of 0.75 a pair has fewer than 28 of 64 equal coordinates with a probability of about 1e-9,
and fewer than 516 of 768 equal bytes with one of about 1e-6; above 0.75 both fall fast.

Edge cases: null and empty texts and texts of white space have no shingles, link with nothing and are kept.
Texts of one to four words have one shingle. Rows with a null doc_id link with nothing, have a null
component and are kept. doc_id names a document: rows that repeat one are one node. An empty table gives an
empty result. `deduplicate` goes by rows instead: null or repeated ids neither hide near-duplicates nor take
other texts with them. Extra columns pass through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, slices, table, text_buffers, without, written
from .components import components
from .words import LOWER, hashes, mixed, spans

COORDINATES, MATCHES, WORDS, BLOCK = 64, 28, 5, 256
LONG, LONG_MATCHES = 768, 516
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all rows, not yet distinct, and the n + 1 offsets of the rows."""
    data, offsets = text_buffers(texts)
    data = LOWER[data]
    begin, end, row = spans(data, offsets)
    words, n = hashes(data, begin, end), len(texts)
    counts = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    full = np.flatnonzero(row[: max(0, len(row) - WORDS + 1)] == row[WORDS - 1 :]) if len(row) >= WORDS else np.zeros(0, np.int64)
    out, of = [np.zeros(len(full), np.uint64)], [row[full]]
    for k in range(WORDS):
        out[0] += words[full + k] * _STEP[k]
    for few in range(1, WORDS):
        short = np.flatnonzero(counts == few)
        part = np.full(len(short), few, np.uint64)
        for k in range(few):
            part += words[first[short] + k] * _STEP[k]
        out.append(part)
        of.append(short)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return mixed(np.concatenate(out))[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def minima(h: np.ndarray, at: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """The minimum hash of every row at each coordinate, 32 bits each; 0 for rows without shingles."""
    draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, coordinates), np.uint64)
    some, out = np.flatnonzero(np.diff(at)), np.zeros((len(at) - 1, coordinates), np.uint32)
    for k in range(coordinates if len(some) else 0):
        value = ((h ^ draw[0, k]) * (draw[1, k] | np.uint64(1))) >> np.uint64(32)
        out[some, k] = np.minimum.reduceat(value.astype(np.uint32), at[some])
    return out


def signatures(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, and the signature, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = shingles(part.column("text"))
                sig = minima(h, at, coordinates, 20240229)
                size, f1, f2 = (np.zeros(len(at) - 1, np.int64) for _ in range(3))
                for r in np.flatnonzero(np.diff(at)):
                    own = np.unique(h[at[r] : at[r + 1]])
                    size[r], f1[r], f2[r] = len(own), own.sum().view(np.int64), mixed(own ^ _STEP[1]).sum().view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, coordinates, dtype=np.int32)), pa.array(sig.view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(f1), pa.array(f2), flat], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig array<int>")


def postings(reps: DataFrame, folder: str, matches: int = MATCHES) -> DataFrame:
    """token, rep, df: the prefix of every representative that can reach `matches` equal coordinates."""
    token = F.shiftleft(F.col("k").cast("bigint"), 32) + F.col("v").cast("bigint")
    tokens = reps.select("rep", F.posexplode("sig").alias("k", "v")).select("rep", token.alias("token"))
    df = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), folder, "frequencies")
    own = Window.partitionBy("rep")
    live = tokens.join(df, "token").withColumns({"left": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("df", "token"))})
    return written(live.filter((F.col("left") >= matches) & (F.col("rank") <= F.col("left") - matches + 1)).select("token", "rep", "df"), folder, "postings")


def confirm(docs: DataFrame, edges: DataFrame, folder: str, name: str, percent: int = 75, broadcast_rows: int = 500_000) -> DataFrame:
    """The edges (a, b; distinct) whose whole shingle sets have 100 * intersection >= percent * union.

    The text of each b is sent once for every 256 or so of its partners, and each partner's text once.
    """
    edges = written(edges, folder, f"{name}-edges")
    hubs = written(edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")), folder, f"{name}-hubs")
    dealt = edges.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / BLOCK).cast("bigint")).alias("salt"))
    dealt = written(dealt, folder, f"{name}-dealt")
    sent = dealt.select("b", "salt", F.col("a").alias("doc"), F.lit(1).alias("place")).unionByName(dealt.select("b", "salt", F.col("b").alias("doc"), F.lit(0).alias("place")).distinct())
    rows = texts_of(docs, sent, broadcast_rows).select("b", "salt", "place", "doc", "text").repartition("b", "salt").sortWithinPartitions("b", "salt", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = shingles(part.column("text"))
                b, place, doc = (part.column(c).to_numpy() for c in ("b", "place", "doc"))
                found = []
                for r in range(len(b)):
                    own = np.unique(h[at[r] : at[r + 1]])
                    if place[r] == 0:
                        hub, base = b[r], own
                    elif hub == b[r] and len(own) and len(base):
                        both = int((base[np.minimum(np.searchsorted(base, own), len(base) - 1)] == own).sum())
                        if 100 * both >= percent * (len(own) + len(base) - both):
                            found.append((doc[r], b[r]))
                pairs = np.array(found, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return written(rows.mapInArrow(run, "a bigint, b bigint"), folder, f"{name}-links")


def leaders(posted: DataFrame, folder: str) -> DataFrame:
    """a, b: every representative and the smallest id of its postings that it shares most of them with."""
    first = written(posted.groupBy("token").agg(F.min("rep").alias("b")), folder, "leaders")
    pairs = posted.join(first, "token").filter("rep <> b").groupBy("rep", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(F.col("rep").alias("a")).agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))


def texts_of(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs (doc, text) joined with ids (doc and more), which is broadcast where it is small."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").filter("doc IS NOT NULL")
    return texts.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "doc")


def long_signatures(texts: DataFrame, coordinates: int = LONG) -> DataFrame:
    """rep, long: one byte for each coordinate; texts: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                found = minima(*shingles(part.column("text")), coordinates, 20240301).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([x.tobytes() for x in found], pa.binary())], names=["rep", "long"])

    return texts.select("doc", "text").mapInArrow(run, "rep bigint, long binary")


def open_pairs(docs: DataFrame, posted: DataFrame, reps: DataFrame, comps: DataFrame, folder: str, matches: int = LONG_MATCHES, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """a, b: all pairs of one posting that lie in different components and match in enough coordinates."""
    marked = posted.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("token", "rep", "df", F.coalesce("component", "rep").alias("comp"))
    marked = written(marked, folder, "marked")
    open_tokens = written(marked.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token"), folder, "open-tokens")
    coordinate = F.shiftright(F.col("token") + (1 << 31), 32).cast("int")
    rows = written(marked.join(open_tokens, "token").withColumn("k", coordinate), folder, "open-postings")
    posts = F.bit_or(F.expr("shiftleft(1L, k)")).alias("posts")
    suspects = written(rows.groupBy("rep").agg(F.first("comp").alias("comp"), posts), folder, "suspects")
    texts = texts_of(docs, suspects.select(F.col("rep").alias("doc")))
    facts = suspects.join(reps.select("rep", "n_shingles", "sig"), "rep").join(long_signatures(texts).dropDuplicates(["rep"]), "rep")
    facts = written(facts, folder, "suspect-facts")
    # In a posting beyond one block, the component with the most members is dealt into blocks of one kind, the rest
    # into blocks of another; two blocks of the first kind need not meet, as their members are linked already.
    sizes = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = F.max(F.struct("n", "comp"))
    shape = sizes.groupBy("token").agg(main.alias("main"), F.sum("n").alias("members"))
    split, counted = F.col("members") > block, lambda n: F.ceil(n / block).cast("int")
    shape = shape.select(
        "token",
        F.when(split, F.col("main.comp")).alias("main"),
        F.when(split, counted(F.col("main.n"))).otherwise(F.lit(0)).alias("inner"),
        F.when(split, counted(F.col("members") - F.col("main.n"))).otherwise(F.lit(1)).alias("outer"),
    )
    rows = rows.join(written(shape, folder, "shapes"), "token")
    inside, h = F.coalesce(F.col("comp") == F.col("main"), F.lit(False)), F.xxhash64("rep")
    own = F.when(inside, F.col("outer") + F.pmod(h, "inner")).otherwise(F.pmod(h, "outer")).cast("int")
    last = F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    rows = rows.select("token", "rep", "k", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other")).join(facts, "rep")
    keyed = rows.groupBy("token", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    gathered = keyed.agg(F.collect_list(F.struct("rep", "comp", "n_shingles", "posts", "own", "sig", "long")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            lists = batch.column("m")
            k_, p, q = (batch.column(c).to_numpy() for c in ("k", "p", "q"))
            flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            if not len(flat):
                continue
            rep, comp, size, posts, of = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(5))
            posts = (posts.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) > 0
            sig = flat.field(5).flatten().to_numpy().reshape(len(rep), -1)
            bytes_ = np.frombuffer(b"".join(flat.field(6).to_pylist()), np.uint8).reshape(len(rep), -1)
            out = []
            for g in range(batch.num_rows):
                rows = slice(at[g], at[g + 1])
                r, c, n, o, s, x, y = rep[rows], comp[rows], size[rows], of[rows], sig[rows], posts[rows], bytes_[rows]
                for i in np.flatnonzero(o == p[g]):
                    near = (o == q[g]) & (c != c[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                    if p[g] == q[g]:
                        near[: i + 1] = False
                    near = np.flatnonzero(near)
                    shared = (s[near] == s[i]) & x[near] & x[i]
                    near = near[shared.argmax(1) == k_[g]]
                    for j in near[(y[near] == y[i]).sum(1) >= matches]:
                        out.append((max(r[i], r[j]), min(r[i], r[j])))
            pairs = np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return gathered.mapInArrow(run, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    sigs = written(signatures(docs), folder, "signatures")
    some = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(some.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), folder, "classes")
    posted = postings(reps, folder)
    links = confirm(docs, leaders(posted, folder), folder, "leaders")
    comps = components(links, f"{folder}/first")
    pairs = written(open_pairs(docs, posted, reps, comps, folder), folder, "open-pairs")
    if not pairs.isEmpty():
        comps = components(links.unionByName(confirm(docs, pairs, folder, "open")), f"{folder}/second")
    classes = written(reps.select("f1", "f2", "n_shingles", "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component")), folder, "members")
    keys = ["f1", "f2", "n_shingles"]
    joined = sigs.drop("sig").join(classes, keys, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates: one row of each group stays, with all its columns.

    Where a doc_id is null or repeated the rows are written once more, numbered, and grouped by their numbers; of
    a group the smallest doc_id stays, null last, of equal ones the first row.
    """
    spark = docs.sparkSession
    folder, doc_id = shared_folder(spark), F.col("doc_id").cast("bigint")
    if docs.groupBy(doc_id.alias("id")).count().filter("id IS NULL OR count > 1").isEmpty():
        gone = written(near_groups(docs).filter("NOT kept").select("doc_id"), folder, "gone")
        return without(docs, gone, {"doc_id": docs["doc_id"].cast("bigint")})
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), folder, "rows")
    groups = near_groups(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    groups = written(rows.select("__row", doc_id.alias("id")).join(groups, "__row"), folder, "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row"))
    stay = groups.groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    gone = written(groups.join(stay, "__row", "left_anti").select("__row"), folder, "gone")
    return without(rows, gone, {"__row": rows["__row"]}).drop("__row")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return near_groups(table(spark, sf_dir, "documents"))

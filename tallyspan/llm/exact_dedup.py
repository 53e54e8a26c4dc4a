"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table with one row for each distinct normalised text, bucketed and sorted by
digest. A batch is reduced to one row for each digest, the sort-merge anti-join with the index needs no
shuffle of the index, and what is new is appended. A text of a later batch that the index holds is
known by the keep_id of the batch that brought it; group sizes count the rows of that batch alone. Digests alone are shuffled, never texts; a digest held
by a third of all rows is pre-aggregated on the map side.

Edge cases: null text counts as empty, and all empty texts are equal. A null doc_id sorts after every
other. Rows that repeat both text and doc_id form one group; `deduplicate` returns one of them. An empty
table gives an empty result. Extra columns of any name pass through `deduplicate` untouched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_folder, table, without, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, n_points INT, group_size BIGINT, batch STRING"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "").cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_points (code points of the original text) for every row."""
    return docs.select("doc_id", digest_of(F.col("text")).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("n_points"))


class DigestIndex:
    """A persistent index of the texts seen so far. `buckets` is fixed when the index is first made.

    `add` may be run again with the same batch name after a failure: what was appended the first time is
    not appended twice, and the batch's accepted rows are read from the index itself.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets or partitions(spark)
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame, name: str) -> DataFrame:
        """Append the digests of batch (doc_id, digest, n_points) that the index lacks; returns the index rows of this batch.

        Of a group the row with the most code points stays, then the smallest doc_id.
        """
        rows = batch.groupBy("digest", "n_points", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("order")))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.sum("copies").alias("group_size"))
        new = groups.select(
            "digest", (-F.col("best.order")).alias("keep_id"), F.col("best.n_points").alias("n_points"), "group_size", F.lit(name).alias("batch")
        ).join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", "n_points", "group_size", "batch").repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.spark.read.schema(INDEX_COLUMNS).parquet(self.path).filter(F.col("batch") == name)


def assign(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for every row of docs, through a new index."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = written(digests(docs), folder, "digests")
    index = DigestIndex(spark, f"{folder}/index")
    groups = index.add(rows, "first")
    # The groups are read by their path; an index that serves one run alone leaves no name in the catalogue.
    spark.sql(f"DROP TABLE {index.name}")
    # The groups are read from their files, so both sides are exchanged and Spark may split a hot digest.
    joined = rows.join(groups.select("digest", "keep_id", "group_size"), "digest")
    return joined.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    groups = written(assign(docs, folder), folder, "groups").select("doc_id", "digest", "kept")
    dropped = groups.filter("NOT kept").select("doc_id", "digest").distinct()
    again = written(groups.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id", "digest"), folder, "again")
    of = digest_of(F.col("text"))
    if again.isEmpty():
        return without(docs, dropped, {"doc_id": docs["doc_id"], "digest": of})
    once = without(docs, dropped.unionByName(again), {"doc_id": docs["doc_id"], "digest": of})
    rows = docs.select(F.col("doc_id").alias("__doc"), of.alias("__digest"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    keys = again.select(F.col("doc_id").alias("__d"), F.col("digest").alias("__g"))
    rows = rows.join(keys, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__digest") == F.col("__g")), "left_semi")
    longest = F.max_by("__row", F.coalesce(F.length("__row.text"), F.lit(0)))
    return once.unionByName(rows.groupBy("__doc", "__digest").agg(longest.alias("__row")).select("__row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

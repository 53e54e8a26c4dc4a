"""Token ids as Arrow stream files with fixed-size-list batches.

`write` packs the ids of documents, in ascending doc_id order and each followed by an end id, into rows
of `width` ids with a mask of as many bits, packed in bytes (1: an id, 0: padding at a shard's end). Ids take
16 bits where the vocabulary allows it, else 32. Every column is a fixed-size list without nulls in
uncompressed batches of `rows` rows, so row i of a shard lies at a place that arithmetic gives, and a
reader maps the file and takes any row, ids and mask, without a copy. A shard is one range
of doc_id; a second file beside it holds where its documents begin, and a Parquet manifest lists the
shards. Files are written under a name of the task's attempt and then moved, so a repeated or a lost task
leaves whole files only.

Texts meet the tokenizer in pieces, cut where no match of its byte-level split crosses: at white space and
between ASCII letters, digits and signs. The cuts of a batch are found in numpy, equal pieces are brought together by
Arrow, and each new one is encoded once; ids of pieces are kept in a bounded memo. Strings of special tokens in a
text are those tokens, as for the library itself; with `special_as_text` they are ordinary text, for corpora whose
documents must not be able to write an end of themselves. Slices of a batch with such a string go whole.

Edge cases: null text counts as empty and gets the end id alone. Rows with one doc_id (or none, which
sorts first) are ordered by the hash of their text and may spread over shards. An empty table gives an
empty manifest and no shards. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import partitions, shared_folder, slices, table, text_buffers, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MEMO = 800_000
LETTER, DIGIT, SIGN, WHITE, OTHER = range(5)
#: The kind of every byte; bytes of multi-byte characters are OTHER until their character is looked at.
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[[9, 10, 11, 12, 13, 32]] = WHITE
#: The white space of Unicode beyond ASCII, in UTF-8.
WIDE_SPACES = [c.encode() for c in "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


@lru_cache(maxsize=4)
def tokenizer(path: str, special_as_text: bool = False) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = special_as_text
    found.no_padding()
    found.no_truncation()
    return found


def kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of every byte, and the length of the white space character that ends at it (1 elsewhere)."""
    kind, length = KIND[data], np.ones(len(data), np.uint8)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        second = data[np.minimum(lead + 1, len(data) - 1)]
        latin = (data[lead] == 0xC3) & (second != 0x97) & (second != 0xB7)
        letters = lead[latin | (data[lead] == 0xD0) | (data[lead] == 0xD1)]
        kind[letters] = kind[letters + 1] = LETTER
        may = lead[np.isin(data[lead], [0xC2, 0xE1, 0xE2, 0xE3])]
        for space in WIDE_SPACES:
            at = may[may + len(space) <= len(data)]
            for k, byte in enumerate(space):
                at = at[data[at + k] == byte]
            for k in range(len(space)):
                kind[at + k] = WHITE
            length[at + len(space) - 1] = len(space)
    return kind, length


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of all rows begin, and the end of the last; no match of the split crosses from one to the next.

    Of white space before something else the last character is cut off, and joins what follows if it is a space:
    the split does the same. White space at a text's end is one piece. An apostrophe stays with letters after it.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    kind, length = kinds(data)
    bound = np.zeros(len(data) + 1, bool)
    before, after, white = kind[:-1], kind[1:], kind == WHITE
    plain = (before < WHITE) & (after < WHITE) & (before != after) & ~((after == LETTER) & (data[:-1] == 0x27))
    bound[1:-1] = plain | (~white[:-1] & white[1:])
    ends = white[:-1] & ~white[1:]
    ends[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
    ends = np.flatnonzero(ends)
    bound[ends + 1 - length[ends]] = True
    bound[ends[data[ends] != 0x20] + 1] = True
    bound[offsets] = True
    return np.flatnonzero(bound)


class PieceEncoder:
    """Encodes columns of texts by their pieces; the memo is emptied when it holds MEMO pieces.

    New pieces go to the tokenizer many at a time, joined by newlines: a newline between two of them is always a
    token of its own. Pieces of white space go alone. The end id is piece 0 of the memo.
    """

    def __init__(self, path: str, end_id: int, special_as_text: bool = False):
        self.tokenizer, self.end_id = tokenizer(path, special_as_text), end_id
        self.newline = self.tokenizer.encode("\n a", add_special_tokens=False).ids[0]
        special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, special))
        self.clear()

    def clear(self) -> None:
        self.memo, self.flat, self.starts = {}, np.array([self.end_id], np.uint32), np.array([0, 1], np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, fresh: np.ndarray) -> np.ndarray:
        """Add new pieces to the memo; returns their places."""
        texts = [x.decode() for x in fresh]
        blank = np.fromiter(map(str.isspace, texts), bool, len(texts))
        flat, ends, used = [self.flat], [self.starts], int(self.starts[-1])
        joint = np.flatnonzero(~blank)
        for k in range(0, len(joint), 5000):
            part = [texts[i] for i in joint[k : k + 5000]]
            ids = self._ids("\n".join(part) + "\n a")[:-1]
            cut = ids == self.newline
            flat.append(ids[~cut])
            ends.append(used + np.flatnonzero(cut) - np.arange(len(part)))
            used = int(ends[-1][-1])
        for i in np.flatnonzero(blank):
            flat.append(self._ids(texts[i]))
            used += len(flat[-1])
            ends.append(np.array([used]))
        places = np.empty(len(fresh), np.int64)
        places[np.concatenate([joint, np.flatnonzero(blank)])] = np.arange(len(fresh)) + len(self.starts) - 1
        self.memo.update(zip(fresh, places.tolist(), strict=True))
        self.flat, self.starts = np.concatenate(flat), np.concatenate(ends)
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with the end id after each, and the number of each text's ids."""
        if self.special and pc.any(pc.match_substring_regex(texts.fill_null(""), self.special)).as_py():
            each = [np.append(self._ids(x or ""), np.uint32(self.end_id)) for x in texts.to_pylist()]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        if len(self.memo) > MEMO:
            self.clear()
        data, offsets = text_buffers(texts)
        cuts = pieces(data, offsets)
        found = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        known, get = found.dictionary.to_numpy(zero_copy_only=False), self.memo.get
        place = np.fromiter((get(x, -1) for x in known), np.int64, len(known))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = self._learn(known[fresh])
        # The end id, piece 0, follows the last piece of each row.
        last = np.searchsorted(cuts, offsets[1:])
        of = np.insert(place[found.indices.to_numpy()], last, 0)
        begin = self.starts[of]
        n = self.starts[of + 1] - begin
        total = np.cumsum(n)
        ids = self.flat[np.repeat(begin - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.diff(total[last + np.arange(len(last))], prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int, special_as_text: bool) -> PieceEncoder:
    """One for each worker, whose memo serves all its tasks."""
    return PieceEncoder(path, end_id, special_as_text)


class ShardWriter:
    """Packs ids into rows of `width` and writes batches of `rows` rows as they fill."""

    def __init__(self, sink, width: int, rows: int, kind: pa.DataType):
        if width % 8:
            raise ValueError("width must be a multiple of 8, as a row's mask fills whole bytes")
        self.width, self.rows, self.kind = width, rows, kind.to_pandas_dtype()
        self.left = np.zeros(0, self.kind)
        fields = [("ids", kind, width), ("mask", pa.uint8(), width // 8)]
        self.schema = pa.schema([pa.field(name, pa.list_(pa.field("item", of, False), size), False) for name, of, size in fields])
        self.out = pa.ipc.new_file(sink, self.schema)

    def _put(self, ids: np.ndarray, mask: np.ndarray) -> None:
        packed = np.packbits(mask, bitorder="little")
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, packed), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.left = np.concatenate([self.left, ids.astype(self.kind)])
        full, at = self.width * self.rows, 0
        while len(self.left) - at >= full:
            self._put(self.left[at : at + full], np.ones(full, bool))
            at += full
        self.left = self.left[at:].copy()

    def close(self) -> None:
        if n := len(self.left):
            padded = -(-n // self.width) * self.width
            ids, mask = np.zeros(padded, self.kind), np.zeros(padded, bool)
            ids[:n], mask[:n] = self.left, True
            self._put(ids, mask)
        self.out.close()


class ShardReader:
    """Random access to a shard: `row(i)` and `span(a, b)` look into the mapped file."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.width = self.file.schema.field("ids").type.list_size
        self.batches: dict[int, pa.RecordBatch] = {}
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def _batch(self, k: int) -> pa.RecordBatch:
        if k not in self.batches:
            self.batches = {k: self.file.get_batch(k)}
        return self.batches[k]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of row i and the bits of its mask (id k: bit k % 8 of byte k // 8), both views of the file."""
        batch, k = self._batch(i // self.rows), i % self.rows
        ids, mask = (batch.column(c).flatten().to_numpy() for c in ("ids", "mask"))
        bits = self.width // 8
        return ids[k * self.width : (k + 1) * self.width], mask[k * bits : (k + 1) * bits]

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the shard's stream; no copy while they lie in one batch."""
        full, parts = self.width * self.rows, []
        while a < b:
            k = a // full
            flat = self._batch(k).column("ids").flatten().to_numpy()
            parts.append(flat[a - k * full : min(b, (k + 1) * full) - k * full])
            a = (k + 1) * full
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint32)])


def write(docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = 2, width: int = 2048, rows: int = 64, special_as_text: bool = False) -> DataFrame:
    """Write shards of docs (doc_id, text) under folder; returns the manifest.

    Manifest: shard, first_id, first_hash, n_docs, n_tokens, start (ids in all shards before), file.
    """
    spark = docs.sparkSession
    kind = pa.uint16() if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else pa.uint32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, bpe = TaskContext.get(), encoder(path, end_id, special_as_text)
        shard, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = pyarrow.fs.FileSystem.from_uri(f"{folder}/shards")
        tokens, places = f"{root}/{shard:06d}.arrow", f"{root}/{shard:06d}.docs.arrow"
        first, n_docs, n_tokens = None, 0, 0
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        sinks: list = []
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                if first is None:
                    first = part.slice(0, 1)
                    fs.create_dir(root, recursive=True)
                    sinks = [fs.open_output_stream(f"{x}.{attempt}") for x in (tokens, places)]
                    shard_out, docs_out = ShardWriter(sinks[0], width, rows, kind), pa.ipc.new_file(sinks[1], schema)
                ids, n = bpe.encode(part.column("text"))
                docs_out.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_tokens + np.cumsum(n) - n), pa.array(n)], schema=schema))
                shard_out.add(ids)
                n_docs, n_tokens = n_docs + len(n), n_tokens + len(ids)
        if first is None:
            return
        shard_out.close()
        docs_out.close()
        for sink, name in zip(sinks, (tokens, places), strict=True):
            sink.close()
            fs.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "first_id": first.column("doc_id"), "first_hash": first.column("h"), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())}
        )

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    shards = written(ranged.mapInArrow(run, "shard int, first_id bigint, first_hash bigint, n_docs bigint, n_tokens bigint"), folder, "ranges")
    # One row a shard, so this window over all of them is small at any size of the input.
    before = F.sum("n_tokens").over(Window.orderBy(F.asc_nulls_first("first_id"), "first_hash").rowsBetween(Window.unboundedPreceding, -1))
    manifest = shards.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("file", F.format_string(f"{folder}/shards/%06d", "shard"))
    return written(manifest, folder, "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, token_ids (little-endian) of every document, read back from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = pyarrow.fs.FileSystem.from_uri(f"{file}.arrow")
                shard = ShardReader(fs, at)
                with fs.open_input_file(f"{at.removesuffix('.arrow')}.docs.arrow") as source:
                    places = pa.ipc.open_file(source)
                    for k in range(places.num_record_batches):
                        part = places.get_batch(k)
                        start, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        ids = [shard.span(a, b).astype("<u4", copy=False).tobytes() for a, b in zip(start, start + n, strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(start + base), part.column("n_tokens"), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "token_ids"])

    n = partitions(manifest.sparkSession)
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, token_ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_folder(spark)
    back = read(write(table(spark, sf_dir, "documents"), folder))
    return written(back.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32")), folder, "read-back")


__all__ = ["PieceEncoder", "ShardReader", "op5_token_files", "read", "write"]

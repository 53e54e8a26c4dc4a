"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before they are encoded: a place where white space follows
something else, or where a letter meets a digit. No match of the split pattern spans such a place, and
the pattern never looks behind it, so the parts' ids are the whole's ids. A text without such a place is
encoded in one piece.

Edge cases: null and empty texts give no ids and decode to no bytes. Every row is encoded on its own, so
repeated rows give repeated results. Extra columns are dropped but for the key.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import shared_folder, slices, table, written

SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def safe_parts(text: str, size: int) -> Iterator[str]:
    """Consecutive parts of text of about `size` characters, cut at safe boundaries alone."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def ids_of(bpe: tiktoken.Encoding, text: str | None, part: int = 20_000) -> np.ndarray:
    """The ids of one text as little-endian unsigned 32-bit integers."""
    return np.concatenate([np.asarray(bpe.encode_ordinary(x), "<u4") for x in safe_parts(text or "", part)])


def bytes_of(bpe: tiktoken.Encoding, ids: bytes) -> bytes:
    """The raw bytes of ids as `ids_of` packs them; nothing assumes that they are valid UTF-8."""
    return bpe.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """key, n_tokens, token_ids (little-endian unsigned 32-bit integers) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks, pattern)
        for batch in batches:
            for rows in slices(batch, text):
                ids = [ids_of(bpe, x.as_py()) for x in rows.column(text)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(key), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=[key, "n_tokens", "token_ids"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, token_ids binary")


def decode(tokens: DataFrame, key: str = "doc_id", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns of `encode` and the decoded raw bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks, pattern)
        for batch in batches:
            for rows in slices(batch, "token_ids"):
                raw = [bytes_of(bpe, x.as_py()) for x in rows.column("token_ids")]
                yield rows.append_column("decoded", pa.array(raw, pa.binary()))

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, "n_tokens", "token_ids").mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, token_ids binary, decoded binary")


def digests(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, its ids are decoded, and digests of both leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks, pattern)
        for batch in batches:
            for rows in slices(batch, "text"):
                n, ids_digest, raw_digest = [], [], []
                for x in rows.column("text"):
                    ids = ids_of(bpe, x.as_py()).tobytes()
                    n.append(len(ids) // 4)
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    raw_digest.append(hashlib.sha256(bytes_of(bpe, ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest), pa.array(raw_digest)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return written(found, shared_folder(docs.sparkSession), "digests")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(table(spark, sf_dir, "documents"))


__all__ = ["decode", "digests", "encode", "op8_byte_bpe", "safe_parts"]

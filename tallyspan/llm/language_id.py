"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows
(`sample_rows` documents, `steps` batches of `batch` byte windows; all are parameters). Every language of the
labelled rows is learned, however rare; the sample is shared equally among them. It labels every byte position
of the whole text, spaces, digits and signs too; a document's probabilities are the mean over all its positions.

The state runs on over words. So that long texts go through in parallel lanes and bounded memory, a text is
cut into windows of `CORE` positions that also read `CONTEXT` bytes of their neighbours on either side, which
warm the states up; each position is labelled once, in the window that it belongs to.

Edge cases: null texts and texts without any letter get `und` and score 0. Labels that are null are not
learned; without any label every text is `und`. An empty table gives an empty result. Repeated rows get
equal results. Ties go to the first language in alphabetical order. `predict` drops extra columns, the
pipeline's filter keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, shared_folder, slices, table, text_buffers, without, written

CORE, CONTEXT, LANES, HIDDEN = 240, 16, 1024, 8
TRAIN_WINDOW, SAMPLE_ROWS, SAMPLE_CHARS = 48, 2000, 3000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Cell:
    """One direction: input rows for each byte, recurrent weights for gates z, r and candidate n."""

    rng: np.random.Generator
    hidden: int
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        h, draw = self.hidden, self.rng.normal
        self.w = {"x": draw(0, 0.3, (256, 3 * h)), "u": draw(0, h**-0.5, (h, 2 * h)), "c": draw(0, h**-0.5, (h, h)), "b": np.zeros(3 * h)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def forward(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States at every position, and what the backward pass needs."""
        n, length, h = len(data), data.shape[1], self.hidden
        state, states, tape = np.zeros((n, h), np.float32), np.empty((n, length, h), np.float32), []
        table_ = self.w["x"] + self.w["b"]
        for t in range(length):
            x = table_[data[:, t]]
            zr = sigmoid(x[:, : 2 * h] + state @ self.w["u"])
            z, r = zr[:, :h], zr[:, h:]
            reset = r * state
            c = np.tanh(x[:, 2 * h :] + reset @ self.w["c"])
            new = c + z * (state - c)
            if keep:
                tape.append((state, z, r, reset, c))
            states[:, t] = state = new
        return states, tape

    def states(self, grid: np.ndarray, n: np.ndarray, back: bool) -> np.ndarray:
        """States (length, hidden, lanes) at every position of a grid (length, lanes) of bytes; lane k has n[k] of them.

        The forward pass without a tape, in place; sigmoids are taken as halved tanh of halved weights. Backwards a
        lane starts at its own end.
        """
        h, lanes = self.hidden, grid.shape[1]
        table_ = np.ascontiguousarray((self.w["x"] + self.w["b"]).T)
        table_[: 2 * h] *= 0.5
        u, c = np.ascontiguousarray(0.5 * self.w["u"].T), np.ascontiguousarray(self.w["c"].T)
        x, gates, new = (np.empty((k * h, lanes), np.float32) for k in (3, 2, 1))
        state, out = np.zeros((h, lanes), np.float32), np.empty((len(grid), h, lanes), np.float32)
        shortest = int(n.min())
        for t in range(len(grid) - 1, -1, -1) if back else range(len(grid)):
            np.take(table_, grid[t], axis=1, out=x, mode="clip")
            np.matmul(u, state, out=gates)
            gates += x[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            gates[h:] *= state
            np.matmul(c, gates[h:], out=new)
            new += x[2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= gates[:h]
            state += new
            if back and t >= shortest:
                state[:, t >= n] = 0
            out[t] = state
        return out

    def backward(self, data: np.ndarray, tape: list, grads: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights by backpropagation through time."""
        h, out = self.hidden, {k: np.zeros_like(v) for k, v in self.w.items()}
        carry = np.zeros_like(grads[:, 0])
        for t in range(data.shape[1] - 1, -1, -1):
            state, z, r, reset, c = tape[t]
            d = grads[:, t] + carry
            dc = d * (1 - z) * (1 - c * c)
            dreset = dc @ self.w["c"].T
            dz, dr = d * (state - c) * z * (1 - z), dreset * state * r * (1 - r)
            dzr = np.hstack([dz, dr])
            out["u"] += state.T @ dzr
            out["c"] += reset.T @ dc
            dx = np.hstack([dzr, dc])
            np.add.at(out["x"], data[:, t], dx)
            out["b"] += dx.sum(0)
            carry = d * z + dreset * r + dzr @ self.w["u"].T
        return out


class Network:
    """Forward and backward cells, and a softmax over languages at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.cells = languages, [Cell(rng, hidden), Cell(rng, hidden)]
        self.out = {"w": rng.normal(0, 0.2, (2 * hidden, len(languages))).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def positions(self, grid: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities (length, languages, lanes) at every position of a grid (length, lanes) of bytes."""
        h = self.cells[0].hidden
        out = np.matmul(self.out["w"][:h].T, self.cells[0].states(grid, n, False))
        out += np.matmul(self.out["w"][h:].T, self.cells[1].states(grid, n, True))
        out += self.out["b"][:, None]
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def _step(self, data: np.ndarray, n: np.ndarray, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, gradient) pairs for one batch of padded windows."""
        rows, length = data.shape
        at = np.arange(length)[None, :]
        flip = np.where(at < n[:, None], n[:, None] - 1 - at, at)
        backwards = np.take_along_axis(data, flip, 1)
        ahead, tape = self.cells[0].forward(data, True)
        back, tape_back = self.cells[1].forward(backwards, True)
        both = np.concatenate([ahead, np.take_along_axis(back, flip[:, :, None], 1)], 2)
        logits = both @ self.out["w"] + self.out["b"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[np.arange(rows)[:, None], at, label[:, None]] -= 1
        p *= (at < n[:, None])[:, :, None] / n.sum()
        p = p.astype(np.float32)
        flat = p.reshape(-1, p.shape[2])
        d = p @ self.out["w"].T
        h = ahead.shape[2]
        grads = [(self.out["w"], both.reshape(-1, 2 * h).T @ flat), (self.out["b"], flat.sum(0))]
        for cell, seen, tape_, g in ((self.cells[0], data, tape, d[:, :, :h]), (self.cells[1], backwards, tape_back, np.take_along_axis(d[:, :, h:], flip[:, :, None], 1))):
            found = cell.backward(seen, tape_, g)
            grads += [(cell.w[k], found[k]) for k in cell.w]
        return grads

    def train(self, data: np.ndarray, n: np.ndarray, label: np.ndarray, steps: int, batch: int, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over batches that draw every language equally often."""
        rng = np.random.default_rng(seed)
        by_language = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        moments: dict[int, list[np.ndarray]] = {}
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(x, batch // len(by_language)) for x in by_language if len(x)])
            for weights, g in self._step(data[rows], n[rows], label[rows]):
                m, v = moments.setdefault(id(weights), [np.zeros_like(weights), np.zeros_like(weights)])
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                weights -= rate * min(1, 2 - 2 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def windows(offsets: np.ndarray, core: int = CORE, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """Begin and end of every window's own positions, begin and end of the window, and its row; n + 1 offsets of rows."""
    size = np.diff(offsets)
    parts = -(-size // core)
    row = np.repeat(np.arange(len(size)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[row] + k * core
    end = np.minimum(begin + core, offsets[row + 1])
    return begin, end, np.maximum(begin - context, offsets[row]), np.minimum(end + context, offsets[row + 1]), row


def document_sums(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the position probabilities of each row; every position counts once, in the window it belongs to."""
    begin, end, first, last, row = windows(offsets)
    rows, classes = len(offsets) - 1, len(net.languages)
    pooled = np.zeros((len(begin), classes))
    order = np.argsort(last - first, kind="stable")
    for k in range(0, len(order) if classes else 0, LANES):
        part = order[k : k + LANES]
        n = (last - first)[part]
        at = first[part] + np.arange(n.max())[:, None]
        p = net.positions(data[np.minimum(at, len(data) - 1)].astype(np.intp), n)
        p *= ((at >= begin[part]) & (at < end[part]))[:, None, :]
        pooled[part] = p.sum(0).T
    return np.stack([np.bincount(row, pooled[:, c], rows) for c in range(classes)], 1) if classes else np.zeros((rows, 0))


def spread(text: Column, chars: int, pieces: int = 10) -> Column:
    """text, or where it is longer than `chars` as many characters in equal pieces from its begin to its end."""
    size = chars // pieces
    begin = lambda k: F.floor(k * (F.length(text) - size) / (pieces - 1)).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substr(text, begin(k), F.lit(size)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(parts, " "))


def training_rows(docs: DataFrame, rows: int, chars: int, least: int = 20) -> tuple[list[str], DataFrame]:
    """All languages of docs, and lang, h, text of about `rows` labelled rows at most.

    Every language has an equal share (`least` at least) or all its rows, chosen by a hash of doc_id and text;
    rows that repeat both count once.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = written(known.select("lang", "h").distinct().groupBy("lang").count(), shared_folder(docs.sparkSession), "languages")
    languages = sorted(r.lang for r in counts.select("lang").collect())
    share = max(least, rows // max(len(languages), 1))
    rates = counts.select("lang", (F.lit(float(share)) / F.col("count")).alias("rate"))
    chosen = known.join(F.broadcast(rates), "lang").filter(F.col("h") / float(1 << 64) + 0.5 <= F.col("rate"))
    return languages, chosen.select("lang", "h", spread(F.col("text"), chars).alias("text")).dropDuplicates(["lang", "h"])


def scrambled(data: np.ndarray, begin: np.ndarray, n: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows of junk, one for each of data: its letters in a random order, or by turns letters drawn alike often from all that occur. Bytes and their number."""
    rng, texts = np.random.default_rng(seed), [data[b : b + k].tobytes().decode("utf-8", "ignore") for b, k in zip(begin, n, strict=True)]
    alphabet = np.array(sorted({c for t in texts for c in t if c.isalpha()}) or ["x"])
    grid, size = np.zeros((len(texts), TRAIN_WINDOW), data.dtype), np.zeros(len(texts), n.dtype)
    for k, text in enumerate(texts):
        chars = np.array(list(text) or ["x"])
        at = np.flatnonzero(np.char.isalpha(chars)) if k % 4 else np.arange(len(chars))
        chars[at] = rng.permutation(chars[at]) if k % 2 else rng.choice(alphabet, len(at))
        raw = np.frombuffer("".join(chars).encode()[:TRAIN_WINDOW], np.uint8)
        grid[k, : len(raw)], size[k] = raw, len(raw)
    return grid, size


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, steps: int = 300, batch: int = 256, junk: bool = False, least_windows: int = 200) -> Network:
    """With `junk`, scrambled windows are one more class, `und`, as large as a language's share; not where the sample has
    fewer than least_windows windows of TRAIN_WINDOW bytes, which don't tell junk from words that it lacks.

    Train on about sample_rows of the rows of docs (doc_id, text, lang) with a language, sample_chars characters of each.

    A batch holds windows of TRAIN_WINDOW consecutive bytes, wherever they begin and end, so the network learns to
    carry its state over the bounds of words.
    """
    languages, chosen = training_rows(docs, sample_rows, sample_chars)
    net = Network(languages)
    if languages:
        sample = chosen.orderBy("h", "lang").toArrow()
        data, offsets = text_buffers(sample.column("text").combine_chunks())
        begin, end, _, _, row = windows(offsets, TRAIN_WINDOW, 0)
        label = np.searchsorted(languages, np.array(sample.column("lang").to_pylist()))[row]
        n = end - begin
        grid = data[np.minimum(begin[:, None] + np.arange(TRAIN_WINDOW), len(data) - 1)]
        if junk and len(begin) >= least_windows:
            net = Network([*languages, "und"])
            some = np.random.default_rng(1).permutation(len(begin))[: max(len(begin) // len(languages), 1)]
            more, size = scrambled(data, begin[some], n[some])
            grid, n, label = np.vstack([grid, more]), np.concatenate([n, size]), np.concatenate([label, np.full(len(more), len(languages))])
        net.train(grid, n, label, steps, batch)
    return net


def predict(docs: DataFrame, net: Network, *carried: str) -> DataFrame:
    """doc_id, lang_pred, score and the columns of `carried` for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(["und", *net.languages], object)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                data, offsets = text_buffers(part.column("text"))
                share = document_sums(net, data, offsets) / np.maximum(np.diff(offsets), 1)[:, None]
                some = part.column("letter").to_numpy(zero_copy_only=False) & bool(net.languages)
                best = share.argmax(1) if net.languages else 0
                score = np.where(some, np.clip(share.max(1, initial=0), 0, 1), 0.0)
                pred = names[np.where(some, best + 1, 0)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *map(part.column, carried)], names=["doc_id", "lang_pred", "score", *carried])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *carried)}
    more = "".join(f", {c} {kinds[c]}" for c in carried)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", letter.alias("letter"), *carried).mapInArrow(run, f"doc_id {kinds['doc_id']}, lang_pred string, score double{more}")


def keep_languages(docs: DataFrame, sure: float = 0.95, least: int = 200) -> DataFrame:
    """docs without the rows that have no letter or that the network takes for junk.

    The network of this stage has one class more, junk: scrambled text of the languages. A row goes where that class
    has a score of `sure` or more and the text has `least` bytes or more; shorter ones are no evidence. Decided by
    row: other texts under the doc_id of a rejected row, or also without one, stay. Null and empty texts go. Without
    any row that has a language, all rows with a letter stay.
    """
    net = fit(docs.filter(fold_of(F.col("doc_id"), 4) != 2), junk=True)
    digest, size = F.sha2("text", 256), F.when(F.col("text").rlike(r"\p{L}"), F.octet_length("text"))
    rows = predict(docs.select("doc_id", "text", digest.alias("digest"), size.alias("size")), net, "digest", "size")
    junk = (F.col("lang_pred") == "und") & (F.col("score") >= sure) & (F.col("size") >= least)
    gone = rows.filter(F.col("size").isNull() | junk).select("doc_id", "digest").distinct()
    return without(docs, written(gone, shared_folder(docs.sparkSession), "rejected"), {"doc_id": docs["doc_id"], "digest": digest})


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    out = predict(docs, fit(docs.filter(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
    return written(out, shared_folder(spark), "languages")

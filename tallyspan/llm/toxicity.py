"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer maps words to symbols: insult (I), threat (T), target (Y), negation (N), reported
speech (R), other (O). Its insult arcs are words and word beginnings with their log-odds, learned from
labelled rows; threats are a fixed list with learned log-odds, the rest is a fixed list. One transducer reads a clause from
its end and turns an insult that a target follows into J. Three more, composed into one, read its output from the
begin: negation turns an insult or threat within three words after N into its negated form; reported speech turns those
after R, up to the clause's end, into their reported form; the target transducer tells insults in a clause
that names a target, before or after them, from the others. Every arc that ends in an event carries the lexicon's weight,
and a clause's matches are the events of its path. A document's score is a logistic function of the summed
weights of each kind of event, fitted by Newton steps.

Texts are searched whole for words that can begin an event; only clauses around these are parsed.

The labels are learned from a bounded sample (`sample_rows` labelled documents, a parameter); everything
else runs over all rows.

Edge cases: null and empty texts have no clause and get the score of a text without matches. Without
labels, or with labels of one kind alone, the score is 0 for all. Labels that are null are left out. An
empty table gives an empty result. Repeated rows get equal results. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of, shared_folder, slices, table, written

SAMPLE_ROWS, FOLDS, HELD, LIMIT, UNSEEN_THREAT = 8000, 3, 1, 0.7, 1.0
#: Closed-class words of the four languages, and threats.
TARGETS = "you your yours he she they him her them this that these those du dich dir dein deine sie ihr ihm er dieser diese tu toi te ton ta vous votre il elle ils ce cette ces tú ti usted ustedes vosotros él ella ellos este esta estos".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't without nicht kein keine keinen nie niemals ohne pas jamais ne sans aucun nunca jamás sin ningún ninguna".split()
REPORTS = "said says say told wrote quoted called claimed claims reported sagte sagt schrieb nannte behauptet zitiert dit disait écrit appelé cité prétend dijo dice escribió llamó citó afirma".split()
THREATS = "kill hurt destroy murder beat töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
WORD, CLAUSE = re.compile(r"[\w']+"), re.compile(r"[.!?;:\n]+")
EVENTS = ("plain", "targeted", "negated", "reported", "threat")


@dataclass
class Transducer:
    """A sequential transducer: arcs[state, symbol] = (output, next state); other symbols pass and keep the state."""

    start: object
    arcs: dict

    def step(self, state: object, symbol: str) -> tuple[str, object]:
        return self.arcs.get((state, symbol), (symbol, state))

    def then(self, other: Transducer, symbols: list[str]) -> Transducer:
        """The composition: self's output is other's input."""
        arcs, todo, seen = {}, [(self.start, other.start)], {(self.start, other.start)}
        while todo:
            a, b = todo.pop()
            for s in symbols:
                middle, a2 = self.step(a, s)
                out, b2 = other.step(b, middle)
                arcs[(a, b), s] = (out, (a2, b2))
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer((self.start, other.start), arcs)


def ahead() -> Transducer:
    """Read from the clause's end: I becomes J where a Y stands after it."""
    return Transducer(0, {(0, "Y"): ("Y", 1), (1, "I"): ("J", 1)})


def negation(reach: int = 3) -> Transducer:
    """I, J and T up to `reach` words after N become I-, J- and T-."""
    arcs: dict = {}
    for left in range(reach + 1):
        for s in "IJTYRO":
            mark = "-" if left and s in "IJT" else ""
            arcs[left, s] = (s + mark, max(0, left - 1))
        arcs[left, "N"] = ("N", reach)
    return Transducer(0, arcs)


def reporting() -> Transducer:
    """After R, I, J and T become I~, J~ and T~ until the clause ends."""
    arcs: dict = {(s, "R"): ("R", 1) for s in (0, 1)}
    arcs |= {(1, x): (x + "~", 1) for x in "IJT"}
    return Transducer(0, arcs)


def targeting() -> Transducer:
    """Events: a plain insult, one with a target on either side, a negated one, a reported one, a threat; others give nothing."""
    arcs: dict = {}
    for s in (0, 1):
        arcs |= {(s, "Y"): ("", 1), (s, "I"): ("targeted" if s else "plain", s), (s, "J"): ("targeted", s), (s, "T"): ("threat", s)}
        arcs |= {(s, x): ("negated", s) for x in ("I-", "J-", "T-")} | {(s, x): ("reported", s) for x in ("I~", "J~", "T~")}
        arcs |= {(s, x): ("", s) for x in ("N", "R", "O")}
    return Transducer(0, arcs)


SYMBOLS = ["I", "J", "T", "Y", "N", "R", "O"]
AHEAD = ahead()
GRAMMAR = negation().then(reporting(), SYMBOLS).then(targeting(), SYMBOLS)
CLOSED = {w: s for words, s in ((TARGETS, "Y"), (NEGATIONS, "N"), (REPORTS, "R"), (THREATS, "T")) for w in words}


def clause_events(clause: list[tuple[str, float]]) -> Iterator[tuple[str, float]]:
    """The events of a clause of (symbol, weight): one pass from its end, then one from its begin."""
    seen, state = [], AHEAD.start
    for s, weight in reversed(clause):
        s, state = AHEAD.step(state, s)
        seen.append((s, weight))
    state = GRAMMAR.start
    for s, weight in reversed(seen):
        event, state = GRAMMAR.step(state, s)
        if event:
            yield event, weight


class Grammar:
    """The lexicon transducer with the composed clause grammar."""

    def __init__(self, lexicon: dict[str, float], stems: dict[str, float], threats: dict[str, float] | None = None):
        self.words, self.stems, self.threats = lexicon, stems, dict.fromkeys(THREATS, UNSEEN_THREAT) | (threats or {})
        self.lengths = sorted({len(s) for s in stems})
        arcs = [re.escape(w) + r"\b" for w in sorted([*lexicon, *THREATS])] + [re.escape(s) for s in sorted(stems)]
        self.trigger = re.compile(r"\b(?:" + "|".join(arcs) + ")")

    def symbol(self, word: str) -> tuple[str, float]:
        """The class of a word and the weight of its arc."""
        if word in self.words:
            return "I", self.words[word]
        for n in self.lengths:
            if (w := self.stems.get(word[:n])) is not None:
                return "I", w
        s = CLOSED.get(word, "O")
        return s, self.threats[word] if s == "T" else 0.0

    def events(self, text: str) -> np.ndarray:
        """Summed weights of each kind of event over all clauses of text."""
        out, text, done = np.zeros(len(EVENTS)), text.lower(), 0
        found = self.trigger.search(text)
        while found:
            begin = done
            for m in CLAUSE.finditer(text, done, found.start()):
                begin = m.end()
            m = CLAUSE.search(text, found.end())
            done = m.end() if m else len(text)
            for event, weight in clause_events([self.symbol(word[0]) for word in WORD.finditer(text, begin, done)]):
                out[EVENTS.index(event)] += weight
            found = self.trigger.search(text, done)
        return out


def odds(counts: DataFrame, name: str, toxic: int, clean: int, support: float, least: float, most: int) -> dict[str, float]:
    """Log-odds of the strongest `most` entries of counts (name, toxic, clean)."""
    ratio = F.ln((F.col("toxic") + 0.5) / (toxic + 1)) - F.ln((F.col("clean") + 0.5) / (clean + 1))
    strong = counts.withColumn("odds", ratio).filter((F.col("toxic") >= support) & (F.col("odds") >= least))
    return {r[name]: float(r["odds"]) for r in strong.orderBy(F.desc("toxic"), name).limit(most).collect()}


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, entries: int = 2000) -> tuple[Grammar | None, np.ndarray]:
    """The grammar and the weights of its events from about sample_rows labelled rows; `entries` bounds the lexicon."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(bounded_sample(known, "doc_id", sample_rows))  # bounded by sample_rows
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).join(sample, "doc_id")
    rows = written(rows, shared_folder(docs.sparkSession), "sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return None, np.zeros(len(EVENTS) + 1)
    support = max(3.0, 0.004 * toxic)
    words = rows.select("toxic", F.array_distinct(F.split("text", r"[^\p{L}\p{N}']+")).alias("words"))
    by_word = words.select("toxic", F.explode("words").alias("word")).filter("length(word) > 2").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    by_word = written(by_word, shared_folder(docs.sparkSession), "words")
    lexicon = odds(by_word, "word", toxic, clean, support, 3.5, entries)
    # A listed threat weighs what the labels say of it, nothing where they say that clean texts have it as often.
    threats = odds(by_word.filter(F.col("word").isin(THREATS)), "word", toxic, clean, 0, -99.0, len(THREATS))
    threats = {w: max(0.0, v) for w, v in threats.items()}
    stems: dict[str, float] = {}
    for size in (4, 5, 6):
        starts = F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) > size), lambda w: F.substring(w, 1, size)))  # noqa: B023
        by_stem = words.select("toxic", F.explode(starts).alias("stem")).groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
        for stem, weight in odds(by_stem, "stem", toxic, clean, 2 * support, 3.5, entries).items():
            if not any(stem.startswith(s) for s in stems):
                stems[stem] = weight
    grammar = Grammar({w: v for w, v in lexicon.items() if not any(w.startswith(s) and len(w) > len(s) for s in stems)}, stems, threats)
    found = features(rows, grammar).join(sample, "doc_id").orderBy("doc_id").toPandas()
    x = np.log1p(np.stack(found["events"].to_numpy()))
    return grammar, logistic(np.hstack([x, np.ones((len(x), 1))]), found["toxic"].to_numpy(float))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps."""
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def features(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, events (summed weights of each kind) for every row."""
    lexicon, stems, threats = grammar.words, grammar.stems, grammar.threats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(lexicon, stems, threats)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [own.events(t).tolist() if t else [0.0] * len(EVENTS) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "events"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, events array<double>")


def score(docs: DataFrame, grammar: Grammar | None, weights: np.ndarray) -> DataFrame:
    """doc_id, score, predicted for every row."""
    if grammar is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    total = F.lit(float(weights[-1]))
    for k in range(len(EVENTS)):
        total = total + float(weights[k]) * F.log1p(F.element_at("events", k + 1))
    out = features(docs, grammar).select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    grammar, weights = learn(docs, labels.filter(~held_out).select("doc_id", "toxic"))
    return score(docs, grammar, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")

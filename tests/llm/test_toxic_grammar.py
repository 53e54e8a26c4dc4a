"""The composed clause grammar against its parts run in turn and against the rules in plain Python; scores against plain sums."""

import itertools
import math
import re

import numpy as np
import pytest

from tallyspan.llm import toxicity


def in_turn(symbols):
    """The four transducers one after another, each over the whole clause."""

    def run(machine, word):
        state, out = machine.start, []
        for s in word:
            s, state = machine.step(state, s)
            out.append(s)
        return out

    word = run(toxicity.ahead(), symbols[::-1])[::-1]
    for machine in (toxicity.negation(), toxicity.reporting(), toxicity.targeting()):
        word = run(machine, word)
    return [e for e in word if e]


def by_rule(symbols):
    """What the rules say of each insult and threat, read from its neighbours."""
    out = []
    for k, s in enumerate(symbols):
        if s in "IT":
            if "N" in symbols[max(0, k - 3) : k]:
                out.append("negated")
            elif "R" in symbols[:k]:
                out.append("reported")
            else:
                out.append("threat" if s == "T" else "targeted" if "Y" in symbols[:k] + symbols[k + 1 :] else "plain")
    return out


def test_composed_grammar():
    """All clauses of up to five symbols, and long random ones."""
    rng = np.random.default_rng(3)
    clauses = [c for n in range(6) for c in itertools.product("ITYNRO", repeat=n)]
    clauses += [tuple(rng.choice(list("ITYNRO"), 40, p=[0.2, 0.1, 0.05, 0.1, 0.02, 0.53])) for _ in range(2000)]
    for c in clauses:
        got = [e for e, _ in toxicity.clause_events([(str(s), 1.0) for s in c])]
        assert got == in_turn(list(c)) == by_rule(list(c)), c


def test_targets_on_both_sides():
    grammar = toxicity.Grammar({"zog": 2.0}, {"blat": 3.0})
    kinds = lambda text: dict(zip(toxicity.EVENTS, grammar.events(text).tolist(), strict=True))
    assert kinds("Zog, you")["targeted"] == 2 and kinds("you zog")["targeted"] == 2 and kinds("Zog. You")["plain"] == 2
    assert kinds("not a zog, you")["negated"] == 2 and kinds("he said blatter, you")["reported"] == 3
    assert kinds("zog blatted you. zog")["targeted"] == 5 and kinds("zog blatted you. zog")["plain"] == 2
    assert kinds("kill you")["threat"] == 1 and not any(kinds("").values())


def test_scores_against_plain(spark):
    """Every row's score is the logistic sum over plainly found clauses; null, empty, long and repeated texts included."""
    rng = np.random.default_rng(5)
    pool = "zog blatter blat you your not never says kill hurt a the plain word Zog YOU é's".split()
    texts = [" ".join(rng.choice(pool, 30)) for _ in range(60)]
    texts = [re.sub(r" (\w+) (\w+) a ", r" \1. \2; a ", t) for t in texts] + [None, "", "x " * 40_000 + "zog you", "...zog", texts[0]] + ["zog " * 30_000]
    grammar, weights = toxicity.Grammar({"zog": 2.0}, {"blat": 3.0}, {"kill": 0.5}), np.array([0.3, 1.1, -0.4, -0.2, 0.7, -2.0])

    def plain(text):
        sums = dict.fromkeys(toxicity.EVENTS, 0.0)
        for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
            words = re.findall(r"[\w']+", clause)
            symbols = ["I" if w == "zog" or w.startswith("blat") else toxicity.CLOSED.get(w, "O") for w in words]
            weight = [2.0 if w == "zog" else 3.0 if s == "I" else {"kill": 0.5}.get(w, toxicity.UNSEEN_THREAT) for w, s in zip(words, symbols, strict=True)]
            found = [w for w, s in zip(weight, symbols, strict=True) if s in "IT"]
            for event, w in zip(by_rule(symbols) if len(words) < 1000 else in_turn(symbols), found, strict=True):
                sums[event] += w
        return 1 / (1 + math.exp(-(weights[-1] + sum(w * math.log1p(v) for w, v in zip(weights, sums.values(), strict=False)))))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, grammar, weights).collect()}
    for k, t in enumerate(texts):
        assert got[k][0] == pytest.approx(plain(t), abs=1e-9) and got[k][1] == int(got[k][0] >= 0.7)

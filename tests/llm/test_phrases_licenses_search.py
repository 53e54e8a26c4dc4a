import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.llm import collocations, lexical_search, license_scan

DOCS = "doc_id bigint, text string, lang string, rank int, phrase string, labels string, score string"


def frame(spark, rows):
    """rows (doc_id, text, lang) with columns named like those of results."""
    return spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Collocations


def phrases(rows, least, top, percent=50):
    """Every phrase counted at once, then the contract's rules one by one."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(100 * f[lang, q] >= percent * a for (other, q) in list(f) if other == lang and len(q) == 3 and f[lang, q] >= least and len(p) == 2 and p in (q[:2], q[1:])):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    found = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        found += [(lang, k, *x[1:]) for k, x in enumerate(own[:top], 1)]
    return sorted(found)


def collocation_rows():
    words = "ab b.c cé D new york city x1 日本 語".split()
    draw = np.random.default_rng(4)
    rows = [(k, " \t".join(draw.choice(words, 30)) + "!\x0bnew york city, new york", ["en", "de", None, "und"][k % 4]) for k in range(60)]
    return [*rows, *rows[:5], (None, None, "en"), (None, "", None), (7, " , ", "fr"), (8, "new york city " * 3000, "en"), (9, "tie a tie b", "en")]


@pytest.mark.parametrize(("shards", "bits"), [(1, 12), (3, 12), (4, 2)])
def test_collocations(spark, shards, bits):
    """Against plain counts; whatever the number of shards, and where most phrases share their slot."""
    rows = collocation_rows()
    got = collocations.collocations(frame(spark, rows), shards=shards, top=25, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == phrases(rows, 10, 25)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, "few words", "en")])).count() == 0


def test_collocation_arithmetic_beyond_64_bits(spark):
    a = F.lit(4_000_000_000).cast("decimal(15,0)")
    assert spark.range(1).select((a * a * F.lit(1_000_000).cast("decimal(7,0)")).alias("up"), (a * a).alias("down")).select(F.expr("up div down").alias("s")).first().s == 1_000_000


# License scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def license_row(doc_id, text, percent=license_scan.PERCENT, window=license_scan.WINDOW):
    """Every block against every template, and every place against every phrase."""
    words = words_of(text)
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = set(), 0.0
    for block in re.split(license_scan.BLOCK_END, text or ""):
        own = words_of(block)
        for at in [0] if len(own) <= window else range(0, len(own) - window // 2, window // 2):
            part = set(own[at : at + window])
            for label, template in license_scan.TEMPLATES:
                wanted = set(words_of(template))
                if 100 * len(part & wanted) >= percent * len(wanted):
                    labels.add(label)
                    best = max(best, len(part & wanted) / len(wanted))
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else round(best, 6)


def test_license_scan(spark):
    notices = [t for _, t in license_scan.TEMPLATES]
    fill = " ".join(f"word{k} the of license" for k in range(40))
    texts = [None, "", " .;\n\n", "CC BY", "cc-by cc by cc\nby", "All rights. Reserved", "all rights reserve", "general public licenses", "Kind permission is granted", "ALL RIGHTS\x00RESERVED " * 3]
    texts += notices + [f"{fill} {n} {fill}" for n in notices] + [n.replace(" the ", " ") for n in notices] + [" ".join(reversed(n.split())) for n in notices] + [n.replace(" ", ".\n\n") for n in notices]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "Released under the MIT License.", "en"), (3, "CC BY", "en"), (99, "long " * 200_000 + "released under the mit license", "en")]
    got = Counter(tuple(r) for r in license_scan.scan(frame(spark, rows)).collect())
    assert got == Counter(license_row(i, t) for i, t, _ in rows)
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0
    assert {r.labels for r in license_scan.scan(frame(spark, rows[:40]), templates=[]).collect()} <= {"", "cc-by", "gpl", "reserved"}


def test_license_filters_lose_nothing(spark):
    """Blocks with each number of a template's words, at thresholds at which the prefix is long."""
    words = [f"t{k}" for k in range(12)]
    templates = [("a", " ".join(words)), ("b", " ".join(words[3:9])), ("c", "")]
    rows = [(k, " ".join(pick), "en") for k, pick in enumerate(itertools.chain.from_iterable(itertools.combinations(words[:7] + ["z"], n) for n in range(4, 9)))]
    for percent in (50, 75, 100):
        got = {r.doc_id: r.labels for r in license_scan.scan(frame(spark, rows), templates=templates, percent=percent).collect()}
        for k, text, _ in rows:
            own = set(text.split())
            want = [label for label, t in templates if t and 100 * len(own & set(t.split())) >= percent * len(t.split())]
            assert got[k] == ",".join(want), (percent, text)


def test_license_scan_is_native(spark):
    plan = license_scan.scan(frame(spark, [(1, "a b", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Lexical search


def ranking(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    counts = [(i, Counter(words(t))) for i, t, _ in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "sample", "a_round"), [(8192, 20_000, 256), (40, 5, 7), (300, 1, 256)])
def test_search(spark, chunk, sample, a_round):
    draw = np.random.default_rng(6)
    words = [f"w{k}" for k in range(60)] + ["日本", "É", "x"]
    odds = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(draw.choice(words, n, p=odds / odds.sum()))
    docs = [(k, text(int(draw.integers(1, 60))), "en") for k in range(500)]
    docs += [docs[3], docs[3], (900, docs[3][1], "en"), (901, None, "en"), (902, "", "en"), (None, docs[3][1], "en"), (903, "w1 " * 50_000, "en"), (904, "É é W1-w2", "en")]
    items = [(k, text(8)) for k in range(25)] + [(100, None), (101, "absent words"), (102, docs[3][1]), (102, docs[3][1]), (103, "É"), (None, "w5 w7")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in lexical_search.top_documents(frame(spark, docs), table, k=10, sample=sample, chunk=chunk, items_a_round=a_round).collect()]
    assert sorted(got, key=str) == ranking(docs, items, 10)
    assert lexical_search.top_documents(frame(spark, docs), table.limit(0)).count() == 0
    assert lexical_search.top_documents(frame(spark, docs).limit(0), table).count() == 0


def test_search_prunes(spark):
    """Documents that hold one item each are found without scoring every pair."""
    n, width = 4096, 256
    ids, gain = np.repeat(np.arange(n) % width, 1), np.full(n, 500_000, np.float32)
    tree, best = lexical_search.ItemTree(np.eye(width) * 1000), lexical_search.Best(np.zeros(width), 3)
    tried = lexical_search.search_chunk(np.arange(n), np.arange(n + 1), ids, gain, tree, best)
    assert tried < n * width / 20 and all(list(x) == [k, k + width, k + 2 * width] for k, x in enumerate(best.ids))


# Departures that were mended in earlier operators


def test_token_ids_equal_the_plain_library(spark):
    """Strings of special tokens are those tokens, as the library takes them."""
    from tokenizers import Tokenizer

    from tallyspan.llm import token_files
    from tallyspan.llm.common import shared_folder

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "plain", None, "x" * 5000 + "<|endoftext|>" + " y" * 5000]
    plain, start = Tokenizer.from_file(token_files.TOKENIZER), 0
    got = token_files.read(token_files.write(frame(spark, [(k, t, "en") for k, t in enumerate(texts)]), shared_folder(spark), width=16, rows=4))
    for r in got.orderBy("doc_id").collect():
        ids = [*plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (start, len(ids)) and zlib.crc32(r.token_ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)

"""Cases that the first tests of the corpus operators leave out."""

import hashlib
import itertools
import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspan.llm import bpe, common, embedding_join, exact_dedup, language_id, minhash, mixing, surrogates, token_files, toxicity, url_filter, words


def replaced(spark, texts, **extra):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in surrogates.replace(df, **extra).collect()}


def test_sample_of_very_many_rows(spark):
    class Huge:
        def count(self):
            return 9_000_000_000

        def filter(self, condition):
            return spark.range(1_000_000).select(F.col("id").alias("doc_id")).filter(condition)

    assert spark.range(1_000_000).filter(common.in_part(F.col("id"), 0.001)).count() == pytest.approx(1000, rel=0.2)
    assert common.bounded_sample(Huge(), "doc_id", 90_000_000).count() == pytest.approx(10_000, rel=0.1)
    assert common.bounded_sample(Huge(), "doc_id", 9_000_000_000).count() == 1_000_000


def test_hashes_of_long_spans(monkeypatch):
    """A span longer than a block, and spans in several blocks, have the hash that one block gives."""
    rng = np.random.default_rng(2)
    data = rng.integers(33, 127, 3000).astype(np.uint8)
    begin, end = np.array([0, 10, 40, 2100, 2500]), np.array([9, 30, 2000, 2400, 3000])
    whole = words.hashes(data, begin, end)
    monkeypatch.setattr(words, "BLOCK", 64)
    words._powers.cache_clear()
    assert (words.hashes(data, begin, end) == whole).all() and len(set(whole.tolist())) == 5
    words._powers.cache_clear()


def test_surrogate_names(spark):
    """Gender, script, capitals, endings, and later mentions of a name that was found."""
    texts = [
        "Mrs. Wilma Stone and Herr Müller und Müller. Müller's dog; Wilma came.",
        "Dr. Wilma Stone; JOHN SMITH met John Smith, Dr. O'Brien, O'Brien again.",
        "г-жа Петрова и Петрова, г-н Петров",
        "Bob Jones",
        "Mr. Hamish McDonald",
        "nothing of Müller or Stone here",
    ]
    got = replaced(spark, texts)
    for k in range(5):
        for name in ("Wilma", "Stone", "Müller", "JOHN", "John", "Smith", "SMITH", "O'Brien", "Петров", "Bob", "Jones", "Hamish", "McDonald"):
            assert name not in got[k].text
    first, last = got[0].text.split()[1:3]
    assert set(first.split("-")) <= set(surrogates.FIRST["f"]) and got[1].text.startswith(f"Dr. {first} {last};")
    assert got[0].text.count(first) == 2 and got[0].text.endswith(f"{first} came.")
    herr = got[0].text.split("Herr ")[1].split()[0]
    assert got[0].text.count(herr) == 3
    shout = got[1].text.split("; ")[1].split(" met ")
    assert shout[0].isupper() and shout[0].lower() == shout[1].split(",")[0].lower()
    assert set(got[4].text.split()[1].split("-")) <= set(surrogates.FIRST["m"])
    woman, man = got[2].text.split()[1], got[2].text.split()[-1]
    assert woman.endswith("ова") and man.endswith("ов") and all("а" <= c.lower() <= "я" for c in woman + man)
    assert got[5].text == texts[5] and got[5].n_entities == 0


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10


def test_surrogate_formats(spark):
    """Check digits, ranges of addresses, and one surrogate for a phone with and without its country."""
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"]
    accounts = ["DE44 5001 0517 5407 3249 31", "GB82WEST12345698765432"]
    ips = ["10.1.2.3", "192.168.4.5", "172.20.1.1", "127.0.0.1", "8.8.8.8"]
    got = replaced(spark, [f"pay {'; '.join(cards)} end", f"to {'; '.join(accounts)} end", f"at {'; '.join(ips)} end", "call 988-555-2485; +1 (988) 555-2485 end"])
    inner = [got[k].text.split(" ", 1)[1].removesuffix(" end").split("; ") for k in range(4)]
    for old, new in zip(cards, inner[0], strict=True):
        digits = "".join(c for c in new if c.isdigit())
        assert new != old and len(new) == len(old) and new[0] == old[0] and luhn(digits) == 0
    for old, new in zip(accounts, inner[1], strict=True):
        bare = new.replace(" ", "")
        assert new != old and len(new) == len(old) and new[:2] == old[:2]
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    parts = [tuple(map(int, x.split("."))) for x in inner[2]]
    assert parts[0][0] == 10 and parts[1][:2] == (192, 168) and parts[2][0] == 172 and 16 <= parts[2][1] <= 31 and parts[3][0] == 127
    assert 128 <= parts[4][0] < 168 and all(x != y for x, y in zip(inner[2], ips, strict=True))
    a, b = (x for x in inner[3])
    assert b.startswith("+1 (") and "".join(c for c in b if c.isdigit()) == "1" + "".join(c for c in a if c.isdigit())


def test_surrogate_card_check_digit(spark):
    """Digits without a card's check digit stay, alone, beside personal data and between two mentions of it."""
    no, yes = "5927243074273351", "4845168114407329"
    texts = [f"order {no} is here", f"order {no} and card {yes} of Mr. Stone", f"{yes}, {no}, {yes}", f"{no} {no}", "order 5927-2430-7427-3351"]
    got = replaced(spark, texts)
    assert luhn(no) and not luhn(yes)
    for k in (0, 3, 4):
        assert (got[k].text, got[k].n_entities, got[k].kinds) == (texts[k], 0, "")
    assert f"order {no} and card 4" in got[1].text and yes not in got[1].text and (got[1].n_entities, got[1].kinds) == (2, "card,person")
    first, middle, last = got[2].text.split(", ")
    assert first == last != yes and middle == no and not luhn(first) and (got[2].n_entities, got[2].kinds) == (2, "card")


def test_surrogate_shapes_and_ordinary_words(spark):
    """Names keep apostrophe, hyphen and second capital, phone numbers their country; ordinary words stay."""
    rows = [
        "Dr. Will May will come in May. Will you? Dr. O'Brien met Jane Doe-Smith. O'Brien's car, O'BRIEN. Mr. Ronald McDonald left. Then Doe-Smith.",
        "+49 30 1234567 and 030 1234567, 030/1234567, 06 12 34 56 78, +351 21 1234567, no phone: 0.12 345678, 12 34 56 78",
        "Mrs. Brown wore a brown coat. Brown is warm. Then Brown left.",
    ]
    got = {k + 1: r.text for k, r in replaced(spark, rows).items()}
    name = r"[A-Z][a-z]+"
    m = re.fullmatch(rf"Dr\. {name} {name} will come in May\. Will you\? Dr\. (O'{name}) met {name} ({name}-{name})\. (O'{name})'s car, (O'[A-Z]+)\. Mr\. {name} [A-Z][a-z]+[A-Z][a-z]+ left\. Then ({name}-{name})\.", got[1])
    assert m and m[1] == m[3] and m[1].upper() == m[4] and m[2] == m[5] and "Brien" not in got[1] and "Doe" not in got[1]
    assert re.fullmatch(r"\+49 \d\d \d{7} and (0\d\d) (\d{7}), \1/\2, 0\d( \d\d){4}, \+351 \d\d \d{7}, no phone: 0\.12 345678, 12 34 56 78", got[2]), got[2]
    assert "1234567" not in got[2]
    m = re.fullmatch(rf"Mrs\. ({name}) wore a brown coat\. Brown is warm\. Then ({name}) left\.", got[3])
    assert m and m[1] == m[2] != "Brown"


def test_surrogates_of_many_mentions(spark):
    """The text equals one put together in plain Python, for thousands of mentions in one text; a planted name is never left."""
    own = ["".join(p).capitalize() for p in itertools.product(["bra", "dro", "fli", "gru", "hek"], ["no", "pa", "ri", "su", "ta"], ["bb", "dd", "ff", "gg", "kk"])]
    parts = [f"Mr. {own[i % len(own)]} wrote to {own[(7 * i) % len(own)].lower()}@firm{i % 40}.org" for i in range(2000)]
    text = " and later ".join(parts) + f" and {own[3]} with {own[5].upper()}"
    new = replaced(spark, [text])[0]
    assert new.n_entities == 4000
    found = re.fullmatch(r"(?s)(.*) and (\w+) with (\w+)", new.text)
    said = [re.fullmatch(r"Mr\. (\w+) wrote to (\S+)", p).groups() for p in found[1].split(" and later ")]
    names, mails = {}, {}
    for p, (name, mail) in zip(parts, said, strict=True):
        old = re.fullmatch(r"Mr\. (\w+) wrote to (\S+)", p).groups()
        assert names.setdefault(old[0], name) == name and mails.setdefault(old[1], mail) == mail
    assert len(set(names.values())) == len(names) and len(set(mails.values())) == len(mails)
    assert found[2] == names[own[3]] and found[3] == names[own[5]].upper()
    assert not set(re.findall(r"[A-Z]\w+", new.text)) & {*own, *(w.upper() for w in own)}


def test_surrogate_edges(spark):
    """Repeated rows, very long texts, clashing columns and other keys."""
    long = "word " * 60_000 + "Mr. John Smith" + " word" * 60_000
    rows = [(1, "Mr. John Smith", "own", 5)] * 2 + [(2, long, "own", 6), (None, "Mr. John Smith", None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kinds string, more int")
    got = surrogates.replace(df).collect()
    assert sorted(r.more for r in got) == [5, 5, 6, 7] and len({r.text for r in got if r.more != 6}) == 1
    new = next(r.text for r in got if r.more == 5).removeprefix("Mr. ")
    assert next(r.text for r in got if r.more == 6) == long.replace("John Smith", new)
    assert replaced(spark, ["Mr. John Smith"], key="another")[0].text != f"Mr. {new}"


def test_token_files_special_and_views(spark, tmp_path):
    """Special strings as text or, by the parameter, as the library takes them; rows and masks are views of the file."""
    texts = ["a <|endoftext|> b", "it's  a  test\n\n x", None, "word, 12ab«é»   y\r\n"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for as_text in (True, False):
        plain.encode_special_tokens = as_text
        ids, n = token_files.PieceEncoder(token_files.TOKENIZER, 2, as_text).encode(pa.array(texts))
        want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    assert 50256 in want[0]
    docs = spark.createDataFrame([(k, "a b c d e f g h i j " * 9) for k in range(3)], "doc_id bigint, text string")
    manifest = token_files.write(docs, f"file://{tmp_path}", width=16, rows=4).orderBy("shard").first()
    reader = token_files.ShardReader(pa.fs.LocalFileSystem(), manifest.file.removeprefix("file://") + ".arrow")
    ids, mask = reader.row(0)
    assert not ids.flags.owndata and not mask.flags.owndata and len(ids) == 16 and np.unpackbits(mask, bitorder="little").all()
    last = -(-manifest.n_tokens // 16) - 1
    ids, mask = reader.row(last)
    assert np.unpackbits(mask, bitorder="little").sum() == manifest.n_tokens - 16 * last
    with pytest.raises(ValueError):
        token_files.ShardWriter(pa.BufferOutputStream(), 12, 4, pa.uint16())


def test_language_forward_pass():
    """The lanes' probabilities are those of a plain pass over each window, byte by byte; every position counts once."""
    net = language_id.Network(["a", "b", "c"], 4)
    texts = ["a 1 bc" * 90, "é", "", "x" * 241, "word " * 100]
    data, offsets = common.text_buffers(pa.array(texts))
    begin, end, first, last, row = language_id.windows(offsets)
    assert [int((end - begin)[row == k].sum()) for k in range(5)] == [len(t.encode()) for t in texts]

    def states(cell, window):
        h, out = np.zeros(4), []
        for byte in window:
            x = cell.w["x"][byte] + cell.w["b"]
            zr = 1 / (1 + np.exp(-(x[:8] + h @ cell.w["u"])))
            c = np.tanh(x[8:] + (zr[4:] * h) @ cell.w["c"])
            h = c + zr[:4] * (h - c)
            out.append(h)
        return np.array(out)

    want = np.zeros((5, 3))
    for b, e, f, x, r in zip(begin, end, first, last, row, strict=True):
        both = np.hstack([states(net.cells[0], data[f:x]), states(net.cells[1], data[f:x][::-1])[::-1]])
        p = np.exp(both @ net.out["w"] + net.out["b"])
        want[r] += (p / p.sum(1, keepdims=True))[b - f : e - f].sum(0)
    assert np.allclose(language_id.document_sums(net, data, offsets), want, atol=1e-3)


def test_language_edges(spark):
    """Repeated rows, long texts and clashing columns; scrambled letters go, others stay."""
    rows = [(k, " ".join(["the and this from"] * 9) if k % 2 else " ".join(["der und nicht mit"] * 9), "en" if k % 2 else "de", "x") for k in range(60)]
    rows += [(1, rows[1][1], None, "x"), (70, "the and this " * 40_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    got = language_id.predict(df, language_id.fit(df, steps=100, batch=64)).collect()
    assert len(got) == 62 and {r.lang_pred for r in got if r.doc_id in (1, 70)} == {"en"}
    assert language_id.keep_languages(df).count() == 62
    rng = np.random.default_rng(8)
    junk = [(100 + k, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 150 * (1 + k % 8))), None, "x") for k in range(40)]
    more = [(300 + k, f"{t} {k}", lang, "x") for k, (_, t, lang, _) in enumerate(rows[:40])]
    kept = language_id.keep_languages(df.union(spark.createDataFrame(more + junk, df.schema))).collect()
    # No clean or short row goes; of the long junk nine in ten do, as the network has learned from few words.
    clean, long = [r for r in kept if r.doc_id < 100 or r.doc_id >= 300], {r[0] for r in junk if len(r[1]) >= 200}
    assert len(clean) == 102 and {r.doc_id for r in kept if 100 <= r.doc_id < 300} >= {r[0] for r in junk} - long
    assert len(long - {r.doc_id for r in kept}) >= 0.9 * len(long)
    plain = spark.createDataFrame([(1, "a", None), (2, "1", None), (3, "zq" * 400, None), (4, None, None)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in language_id.keep_languages(plain).collect()} == {1, 3}


def test_toxicity_learns(spark):
    """Insults are learned from labels; negated and reported ones weigh less; odd labels and tables don't crash."""
    rng = np.random.default_rng(4)
    filler = [f"plain{k}" for k in range(80)]
    rows, labels = [], []
    for k in range(400):
        text = " ".join(rng.choice(filler, 12))
        toxic = k % 4 == 0
        rows.append((k, (text + ". you are a zogblat. " + text) if toxic else text, "x"))
        labels.append((k, int(toxic)))
    rows += [(400, "", "x"), (401, None, "x"), (402, "plain1 " * 50_000 + ". you zogblat", "x"), (0, rows[0][1], "x")]
    labels += [(400, None), (None, 1), (5, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    grammar, weights = toxicity.learn(docs, known)
    assert "zogblat" in grammar.words or any("zogblat".startswith(s) for s in grammar.stems)
    got = toxicity.score(docs, grammar, weights).collect()
    flagged = {r.doc_id for r in got if r.predicted}
    assert flagged == set(range(0, 400, 4)) | {402} and len(got) == 404
    assert all(v >= 0 for v in grammar.threats.values())
    assert toxicity.learn(docs, known.filter("toxic = 0"))[0] is None
    assert toxicity.score(docs, None, np.zeros(6)).filter("predicted = 1 OR score > 0").count() == 0
    assert toxicity.score(docs.limit(0), grammar, weights).count() == 0


def test_url_reputation(spark):
    """A host is blocked by its own evidence, or by its domain's alone; single bad paths and few pages are not enough."""
    rows = [(k, f"http://casino.bad.test/{k}") for k in range(40)]
    rows += [(100 + k, f"http://h{k}.foul.test/p{j}") for k in range(30) for j in range(8)] + [(900, "http://fresh.foul.test/")]
    rows += [(1000 + k, f"http://fine.good.test/{'casino' if k == 3 else k}") for k in range(40)] + [(2000, "http://poker.lone.test/"), (2000, "http://poker.lone.test/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.host: r.verdict for r in url_filter.judge(pages).collect()}
    assert got["casino.bad.test"] == "block" and got["fine.good.test"] == got["poker.lone.test"] == "allow"
    told = pages.select("page_id", F.col("url").contains("foul").cast("int").alias("bad")).filter("page_id <> 900")
    for limit in (200_000, 0):
        judged = url_filter.judge(pages, outcomes=told, most_bad=0.6, broadcast_hosts=limit)
        got = {r.host: r.verdict for r in judged.collect()}
        assert got["h3.foul.test"] == got["fresh.foul.test"] == "block" and got["fine.good.test"] == "allow"
    assert judged.count() == len(rows)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_beta_tail():
    grid = (np.arange(400_000) + 0.5) / 400_000
    for a, b in ((15.0, 1.5), (2.0, 3.0), (1.0, 40.0), (300.0, 60.0)):
        density = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid))
        assert url_filter.beta_cdf(0.8, np.array([a]), np.array([b]))[0] == pytest.approx(density[grid < 0.8].sum() / 400_000, abs=1e-4)


def test_mixing_edges(spark):
    """Null sources and ids, repeated rows, texts without characters, clashing columns."""
    rows = [(None, "abc", None, "own"), (None, "abc", None, "own"), (1, "", "s", "own"), (2, None, "s", "own"), (3, "abcdef", "t", "own")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")
    got = mixing.mix(df, budget=20.0)
    assert got.columns == ["doc_id", "text", "source", "copy", "shuffle_key"] and dict(got.dtypes)["copy"] == "int"
    n = {(r.doc_id, r.source): r["count"] for r in got.groupBy("doc_id", "source").count().collect()}
    assert n[None, None] % 2 == 0 and n[None, None] > 0 and (3, "t") in n


def test_minhash_repeated_ids(spark):
    """Rows of one doc_id are one node; whatever they are, every row comes back."""
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(1, base), (1, base), (2, base + " end"), (3, "other text of its own here"), (3, None)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}


def test_embeddings_planted_and_repeated(spark):
    """Planted copies at many angles over several tiles, in both precisions, against brute force; repeated and clashing columns."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 160))
    x[150:] = x[:150] + rng.normal(size=(150, 160)) * rng.uniform(0.05, 0.6, (150, 1))
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    for kind in ("float", "double"):
        df = spark.createDataFrame([(k, v.tolist(), "own") for k, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>, n_links string")
        got = {r.vec_id: r.n_links for r in embedding_join.similar(df, block=8).collect()}
        assert got == {k: int(near[k].sum()) for k in range(300)} and sum(got.values()) > 60
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_join.similar(twice).collect()) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_exact_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (None, "ab"), (3, "ab " * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.assign(docs).collect()}
    assert got == {1: (1, 3), 2: (1, 3), None: (1, 3), 3: (3, 1)}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_bpe_operators(spark):
    """encode and decode as operators give what the digests say, raw bytes included."""
    texts = [None, "", "aé \U0001f600 word's 12ab", "x" * 50_000]
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id bigint, text string, decoded string")
    both = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    said = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for k, t in enumerate(texts):
        assert bytes(both[k].decoded) == (t or "").encode() and said[k].n_tokens == both[k].n_tokens
        assert said[k].ids_sha256 == hashlib.sha256(bytes(both[k].token_ids)).hexdigest()

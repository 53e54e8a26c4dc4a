"""Outcomes of pages from their content, against plain Python, and what they do to hosts."""

import re

import duckdb
from pyspark.sql import functions as F

from tallyspan.llm import url_filter


def plain(html):
    """bad_content in plain Python: parts are taken out one after another, from left to right."""
    blocks, at, low = [""], 0, (html or "").lower()
    while at < len(low):
        if low.startswith("<!--", at):
            end = low.find("-->", at + 4)
            at, end = (len(low) if end < 0 else end + 3), None
        elif m := re.match(r"<(script|style|head|nav|footer)\b", low[at:]):
            close = re.compile(rf"</{m[1]}\s*>").search(low, at)
            at = close.end() if close else len(low)
        elif low[at] == "<":
            end = low.find(">", at)
            at = len(low) if end < 0 else end + 1
        else:
            blocks[-1] += html[at]
            at += 1
            continue
        blocks.append("")
    blocks = [b for b in blocks if b.strip(" ")]
    total, once = sum(map(len, blocks)), sum(map(len, set(blocks)))
    words = re.findall("[a-z0-9]+", " ".join(blocks).lower())
    listed = sum(w in url_filter.BAD_WORDS for w in words)
    return total > 0 and (2 * once <= total or (listed >= 3 and 50 * listed >= len(words)))


def test_content_against_plain(spark):
    prose = " ".join(f"word{k}" for k in range(140))
    texts = [
        None,
        "",
        "   ",
        "<p></p><br>",
        "no tags at all",
        "<p>same</p><p>same</p>",
        "<p>same</p><p>same</p><p>another one</p>",
        "<P>same</P><Script>x</p>same</SCRIPT ><p>same</p>",
        "<nav>same</nav><p>same</p><footer>same</footer>",
        "<!-- a --><p>a</p><!-- a",
        "<header>x</header><p>x</p><headline>x</headline>",
        "<script>never closed <p>casino casino casino",
        f"<p>{prose} casino poker slots</p>",
        f"<p>{prose} {prose} casino poker slots</p>",
        f"<p>{prose} casino poker</p>",
        "<p>casino, Poker! SLOTS</p>",
        "casino poker slots <open at the end",
        "<p>\n</p><p>\n</p>",
        "<p>aé</p>" * 3 + "<p>İSTANBUL</p>",
        "<p>" + "long text " * 40_000 + "</p>",
        "<script" * 5000,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string")
    got = {r.page_id: r.bad for r in rows.select("page_id", url_filter.bad_content(F.col("html")).alias("bad")).collect()}
    want = {k: plain(t) for k, t in enumerate(texts)}
    assert got == want and 4 < sum(want.values()) < 12


def test_content_judges_hosts(spark):
    """One stuffed page is enough under a domain of such pages, not elsewhere; a listed word alone is not, and a clean page speaks for its host."""
    stuffed, clean = "<p>win now</p>" * 9, "<h1>About</h1><p>A text that says something once.</p>"
    rows = [(k, f"http://h{k % 12}.foul.test/p{k}", stuffed) for k in range(96)] + [(200, "http://fresh.foul.test/", stuffed), (210, "http://lone.test/", stuffed), (220, "http://tidy.foul.test/", clean)]
    rows += [(300 + k, f"http://good{k % 3}.test/{k}", stuffed if k == 5 else clean) for k in range(90)]
    rows += [(400, "http://good0.test/casino/history", clean), (401, "http://casino.museum.test/", clean), (402, None, None), (402, None, None), (403, "good.test", "<p")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("verdict", F.lit("own"))
    judged = url_filter.judge(pages, most_bad=0.6)
    got = {(r.page_id, r.host): r.verdict for r in judged.collect()}
    assert judged.count() == len(rows)
    assert all(got[k, f"h{k % 12}.foul.test"] == "block" for k in range(96)) and got[200, "fresh.foul.test"] == "block"
    assert got[210, "lone.test"] == got[220, "tidy.foul.test"] == "allow"
    assert {v for (k, _), v in got.items() if k >= 300} == {"allow"}
    # Without the content nothing speaks against these hosts.
    assert url_filter.judge(pages.drop("html"), most_bad=0.6).filter("verdict = 'block'").count() == 0
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_rules_of_contract(spark):
    """Each rule's word as the contract lists it, in the code and in the SQL."""
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = ["http://a.com/en/1", "http://www.example.com/en/71", "http://example.com/en/6", "http://b.net/de/8", "http://net/de/", "http://example.net/de/7", "http://example.net/de/80?q", "http://x.example.net/de/8", "http://c.org/es/9"]
    rules = ["com/en/", "example.com/en/7", "com/en/", "net/de/", "net/de/", "net/de/", "example.net/de/8", "example.net/de/8", "org/es/"]
    want = {k: (rule, said[rule]) for k, rule in enumerate(rules)}
    pages = spark.createDataFrame([(k, u, "<p>x</p>") for k, u in enumerate(urls)], "page_id bigint, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages).collect()} == want
    base = duckdb.connect()
    base.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    base.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(k, u, "<p>x</p>") for k, u in enumerate(urls)])
    assert {r[0]: (r[3], r[4]) for r in base.execute(url_filter.OP10_SQL).fetchall()} == want

"""Relative links, short items, alike rows and columns named like the operators' helpers."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from check import compare
from seqlytics.llm import decontaminate, mixing, sharding, toxicity, url_filter
from seqlytics.llm.queries import QUERIES

DOC = "doc_id long, text string"
CANONICAL = '<head><link rel="canonical" href="{}"></head>'
LINKS = {
    "next.html": "h.org/a/b/next.html",
    "../up": "h.org/a/up",
    "../../../far/./x": "h.org/far/x",
    "./": "h.org/a/b/",
    "..": "h.org/a/",
    "/root/../r": "h.org/r",
    "?a=1&amp;b=2": "h.org/a/b/page?a=1&b=2",
    "n.html?q=../x#part": "h.org/a/b/n.html?q=../x",
    "//Other.ORG/Z": "other.org/Z",
    "HTTPS://k.org&#x2F;w": "k.org/w",
    "mailto:x@y.org": None,
    "#part": None,
    "a:b": None,
}


@pytest.mark.parametrize("ref", LINKS)
def test_references(spark, ref):
    pages = spark.createDataFrame([("http://H.org/a/b/page?old=1#f", CANONICAL.format(ref))], "url string, html string")
    got = [tuple(r) for r in url_filter.link_edges(pages).collect()]
    assert got == ([("h.org/a/b/page?old=1", LINKS[ref])] if LINKS[ref] else [])


def test_links_of_a_page_without_a_path(spark):
    pages = spark.createDataFrame([("http://h.org", CANONICAL.format("x") + CANONICAL.format("?q")), (None, CANONICAL.format("x"))], "url string, html string")
    assert {r.dst for r in url_filter.link_edges(pages).collect()} == {"h.org/x", "h.org?q"}


def test_planted_links_against_sql(spark, tmp_path):
    """Chains of relative links from urls without a rule to ruled ones, and a page with two canonical links."""
    rows = [(i, f"http://site{i}.org/d/e{i}/page", CANONICAL.format(ref)) for i, ref in enumerate(LINKS)]
    ends = ["d/e0/next.html", "d/up", "far/x", "d/e3/", "d/", "r", "d/e6/page?a=1&b=2", "d/e7/n.html?q=../x"]
    rows += [(100 + i, f"http://site{i}.org/{end}", CANONICAL.format(f"http://www.bad.net/es/{i}")) for i, end in enumerate(ends)]
    rows += [(200, "http://two.org/", CANONICAL.format("one") + CANONICAL.format("//x.net/fr/2")), (201, "http://two.org/one", "<p>"), (202, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    query, sql = QUERIES["op1_redirect_filter"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    good, note = compare(spark, con, str(tmp_path), "op1_redirect_filter", query, sql)
    assert good, note
    verdict = {r.page_id: r.verdict for r in query(spark, str(tmp_path)).collect()}
    assert {verdict[i] for i in range(len(ends))} == {verdict[100 + i] for i in range(len(ends))} == {verdict[200], verdict[201]} == {"block"}
    assert verdict[202] == "allow"


TAKEN = ["_own", "_row", "_key", "_node", "_ok", "action", "_hash", "_cell", "_depth", "_total", "_size", "_copy", "_times", "_i", "_at", "_toxicity", "size", "n", "row"]


def test_columns_named_like_helpers(spark):
    rng = random.Random(1)
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30)) + (" " + item if i == 7 else ""), "s") for i in range(40)]
    docs = spark.createDataFrame(rows, DOC + ", source string").select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in TAKEN])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(40)], "doc_id long, toxic int")
    made = {
        "clean": decontaminate.clean(docs, bench),
        "mix": mixing.mixed_rows(docs),
        "shard": sharding.shard(docs, 600),
        "toxic": toxicity.reject(docs, toxicity.fit(docs, labels)),
        "judge": url_filter.judge(docs.withColumns({"url": F.concat(F.lit("http://h.org/"), "doc_id"), "html": F.lit("")}), url_filter.rule_table(docs, [("block", "h.org", "/")])),
    }
    assert made["clean"].count() == 39 and made["shard"].count() == made["judge"].count() == 40
    for name, df in made.items():
        assert set(docs.columns) <= set(df.columns), name
        got = df.collect()
        assert got and all(r[c] == f"{c}:{r.doc_id}" for r in got for c in TAKEN), name


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "who wrote war peace"), (2, "capital"), (3, "Paris  france"), (4, ""), (None, "x y")], "item_id long, text string")
    rows = [(1, "Who wrote\nWAR peace"), (2, "so who wrote war peace ? who wrote war peace"), (3, "wrote war peace"), (4, "a capital idea"), (5, "capital"), (6, "paris france"), (7, None), (None, "capital")]
    docs = spark.createDataFrame(rows, DOC)
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.hits(docs, bench).collect()}
    assert got == {
        (1, 1): (0, 4, 1.0), (2, 1): (1, 4, 1.0), (4, 2): (1, 1, 1.0), (5, 2): (0, 1, 1.0), (6, 3): (0, 2, 1.0), (None, 2): (0, 1, 1.0),
    }
    # single words and pairs are common; only a text that is nothing else goes for them
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect()) == ["3", "4", "7"]


def test_copies_of_alike_rows(spark):
    text = " ".join(["w"] * 10)
    rows = [(None, text, "a", i) for i in range(1000)] + [(i % 5, text, "b", i) for i in range(1000)] + [(None, None, "b", 0)]
    docs = spark.createDataFrame(rows, DOC + ", source string, n int").repartition(5)
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    kept = mixing.mixed_rows(docs).collect()
    words = Counter()
    for r in kept:
        words[r.source] += 10
    assert all(abs(words[s] - target[s]) <= 10 for s in target)
    assert max(Counter((r.source, r.n) for r in kept).values()) <= 2
    again = mixing.mixed_rows(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, kept))

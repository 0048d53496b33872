"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from roadveil.llm import htmltext, langid, lattice, packing, pieces, pii, simhash, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, p string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    long = "lorem ipsum " * 20_000
    texts = [None, "", "   ", "one", "two words", "same text here again", "same text here again", "Grüße aus Köln", "x@y.zz +1 (555) 123-4567", long, "same text here again", None]
    ids = [*range(len(texts) - 2), 6, None]
    rows = [(i, t, None if k % 3 == 0 else "en", None, None, "a", "b", "c", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (8, 0, 1), (8, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    return {
        "simhash": lambda d: simhash.near_duplicates(spark, d),
        "pieces": lambda d: pieces.encode(d),
        "langid": lambda d: langid.identify(d),
        "toxicity": lambda d: toxicity.score(spark, d, labels),
        "pii": lambda d: pii.find(spark, d),
    }


@pytest.mark.parametrize("name", ["simhash", "pieces", "langid", "toxicity", "pii"])
def test_one_row_a_document(spark, docs, labels, name):
    run = operators(spark, labels)[name]
    got = run(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
    assert run(docs.limit(0)).count() == 0


def test_packing_and_filters(spark, docs, labels):
    got = packing.pack(docs).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}
    assert packing.pack(docs.limit(0)).count() == 0
    for keep in (lambda d: toxicity.keep_clean(spark, d, labels), langid.keep_identified, lambda d: simhash.keep_one(spark, d), lambda d: pii.sanitise(spark, d)):
        assert keep(docs).columns == docs.columns
        assert keep(docs.limit(0)).count() == 0
    ones = simhash.keep_one(spark, docs).collect()
    assert sorted(r["doc_id"] for r in ones if r["doc_id"] is not None) == [0, 3, 4, 5, 7, 8, 9]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs).collect()}
    assert clean[8] == "[EMAIL] [PHONE]" and clean[3] == "one" and clean[0] is None


def test_pages(spark):
    rows = [(1, None, None), (2, "http://COM/", "<p>a"), (3, "no scheme", ""), (4, "x://a.B.net/fr/1?q#z", "<a href='//Other.org/x'>y</a>"), (4, "x://a.B.net/fr/1?q#z", None), (None, "http://Example.com/en/x", "<p>"), (7, "http://www.example.com/en/", None), (8, "http://example.com?x=/en/", None), (9, "http://b.net/it/#://", None), (10, "http://" + "a." * 3000 + "net/de/", None)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, bad string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(spark, pages).collect()}
    assert got[1] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[2] == ("com", "/", "com/", "allow")
    assert got[4] == ("a.b.net", "/fr/1", "net/fr/", "block")
    assert got[None] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[7][2:] == ("www.example.com/en/", "allow") and got[8][:3] == ("example.com", "", None)
    assert urlfilter.judge(spark, pages.limit(0)).count() == 0
    text = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    assert text[1] is None and text[2] == "a" and text[3] == ""
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, []), (8, [None, 1.0]), (None, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(spark, df).collect())
    assert [g[1:] for g in got] == [(4, 0, True), (4, 0, False), (4, 0, False), (4, 0, False), (0, 3, True), (0, 4, True), (0, 5, True), (0, 6, True), (0, 7, True), (0, 8, True), (0, 20, True), (0, 40, True), (4, 0, False)]
    assert lattice.near_duplicates(spark, df.limit(0)).count() == 0
    top = topk.top_k(spark, df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(top, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {0: [(2, 8192), (1, 4096), (1, 4096), (6, 0), (20, 0)], 20: [(0, 0), (1, 0), (1, 0), (2, 0), (6, 0)]}
    assert topk.top_k(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0

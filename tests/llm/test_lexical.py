"""Ranked lexical search against scoring every document for every item."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import lexical, queries

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(documents, items, k=10):
    found = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in documents]
    found = [(d, c) for d, c in found if c]
    terms, n_docs, total = defaultdict(set), len(found), sum(sum(c.values()) for _, c in found)
    for item, text in items:
        terms[item] |= set(TERM.findall((text or "").translate(LOWER)))
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, own in terms.items():
        hits = []
        for d, counts in found:
            m = 10 + 90 * sum(counts.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m)) for t in own if counts[t])
            if score > 0:
                hits.append((-score, d is None, d or 0, d))
        out += [(item, rank, h[3], -h[0]) for rank, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark")}


def test_query(spark, tables):
    wanted = plain(tables["documents"].select("doc_id", "text").collect(), tables["benchmark"].select("item_id", "text").collect())
    assert got(queries.op12_lexical_search(spark, "/root/testdata/sf0.001")) == wanted


def test_odd_rows(spark, odd, tables):
    texts = [(None, "same line of text here TOKEN"), (1, None), (2, ""), (3, "..."), (4, "été 漢字 😀 ÉTÉ x"), (5, "nothing0 matches1"), (None, "a b c user=alice"), (6, "a " * 500 + "contig"), (7, "x y one")]
    items = spark.createDataFrame([(*r, 1, "x") for r in texts], "item_id long, text string, rank long, score string")
    many = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(spark.createDataFrame([(i, "a contig " + "contig " * (i % 7 * 60)) for i in range(400)], "doc_id long, text string"), allowMissingColumns=True)
    for docs in (odd, many.repartition(5)):
        wanted = plain(docs.select("doc_id", "text").collect(), texts)
        index = lexical.build_index(docs).cache()
        assert got(lexical.search(index, items)) == wanted
        assert got(lexical.search(index, items, block_items=2, block_rows=7)) == wanted
        narrow = lexical.build_index(docs, width=4)
        assert got(lexical.search(narrow, items, width=4)) == wanted


def test_empty_tables(spark, tables):
    docs, items = tables["documents"], tables["benchmark"]
    assert got(lexical.search(lexical.build_index(docs.limit(0)), items)) == []
    assert got(lexical.search(lexical.build_index(docs), items.limit(0))) == []
    assert got(lexical.search(lexical.build_index(docs), items.where("item_id < 0"))) == []


def test_long_text(spark):
    long = "word " * 700_000 + "x" * 1_000_000
    docs = [(1, long), (2, "word"), (3, " " * 1_500_000 + "other")]
    items = [(1, "word"), (2, "x" * 1_000_000), (3, "other word")]
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    assert got(lexical.search(lexical.build_index(frame(docs, "doc_id")), frame(items, "item_id"))) == plain(docs, items)

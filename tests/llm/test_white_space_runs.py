"""Runs of a million white-space characters, and words of that length, in all operators."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixframe.llm import attribution, chunks, linededup, mixing, nearcopies, packing, quality, queries, secrets, sharding, simhash
from helixframe.llm.tokens import RankTokenizer, vocabulary

KINDS = [" ", "\n", "\t", "\r\n", "\xa0", "　", " ", "\x85", " \n"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), RankTokenizer(*vocabulary())


@pytest.mark.parametrize("kind", KINDS)
def test_ids_of_runs(both, kind):
    t, own = both
    for n in (99_999, 100_002):
        run = kind * (n // len(kind))
        for text in (run + "end", "start" + run, "one" + run + "two" + run, "a<|endoftext|>" + run + "<|endoftext|>" + run + "b"):
            ids = own.encode(text)
            assert np.array_equal(ids, np.array(t.encode(text, add_special_tokens=False).ids, "<u4"))
            assert own.byte_lengths[ids].sum() == len(text.encode())


def test_ids_of_the_longest_runs(both):
    t, own = both
    for text in ("one" + " " * 2_000_000 + "two", "\n" * 2_000_000, "\x1c" * 200_000 + "x"):
        assert own.tokens(text) == t.encode(text, add_special_tokens=False).ids


def test_all_operators(spark):
    texts = ["few words here" + " " * 1_500_000 + "and there", "\n" * 1_200_000, "\xa0" * 1_000_000, "x" * 1_500_000, " ", None]
    docs = spark.createDataFrame([(i, x, "en", "s", 7) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    n = {r.doc_id: r.n for r in packing.pack(docs, *vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    own = RankTokenizer(*vocabulary())
    assert n == {i: len(own.tokens(x or "")) + 1 for i, x in enumerate(texts)}
    counted = attribution.count_tokens(docs, *vocabulary(), fields=("text",), sectioned="text").groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    assert {r.doc_id: r.n for r in counted.collect()} == {i: k - 1 for i, k in n.items()}
    rules = {r.doc_id: r for r in quality.apply_rules(docs, *queries._fertility()).collect()}
    assert [rules[i].n_words for i in range(6)] == [5, 0, 1, 1, 0, 0] and rules[2].word_chars == 1_000_000
    assert secrets.find_secrets(docs).count() == 6
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    assert nearcopies.near_copies(docs, "doc_id").count() == 6
    lines = {r.doc_id: r for r in linededup.deduplicate_lines(docs).collect()}
    assert lines[1].n_lines == 1_200_001 and hashlib.md5(lines[0].text.encode()).digest() == hashlib.md5(texts[0].encode()).digest()
    assert chunks.repeated_passages(docs).count() == 0
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {0: 5, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    assert {r.doc_id: r.bytes for r in sharding.shard(docs, max_bytes=1 << 20).collect()} == {i: len((x or "").encode()) for i, x in enumerate(texts)}

"""Texts with the special token's string against the tokenizer as it comes."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers

from helixframe.llm import attribution, queries
from helixframe.llm.tokens import RankTokenizer, vocabulary

TEXTS = ["<|endoftext|>", "a <|endoftext|> b", "one  <|endoftext|>  two\n\n<|endoftext|><|endoftext|>\n", "x<|endoftext|", "<|endoftext|>é漢😀 <|ENDOFTEXT|>", "no such thing", ""]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids():
    t, own = tokenizer(), RankTokenizer(*vocabulary())
    for text in TEXTS:
        ids = own.encode(text)
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        assert own.byte_lengths[ids].sum() == len(text.encode())
    assert own.encode(TEXTS[0]).tolist() == [50256]


def test_queries(spark, monkeypatch):
    t = tokenizer()
    docs = spark.createDataFrame([(i, x, "en", "web") for i, x in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(TEXTS)}
    rows = queries.op2_packing(spark, "").collect()
    assert all(r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    counts = attribution.count_tokens(docs.where("doc_id = 1"), *vocabulary(), fields=("source", "text")).collect()
    assert sum(r.n_tokens for r in counts) == len(t.encode("web " + TEXTS[1], add_special_tokens=False).ids)

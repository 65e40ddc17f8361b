"""Katz scores against a model in dictionaries, whose probabilities are summed."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import katz, queries
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, START = " end", " start"


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def shares(counts):
    """d(1) .. d(5), and for any higher count."""
    often = Counter(counts)
    own = {}
    common = 6 * often[6] / often[1] if often[1] else 1
    for r in range(1, 6):
        own[r] = 1 - 1 / (r + 1) ** 2
        if common < 1 and often[r]:
            estimate = ((r + 1) * often[r + 1] / often[r] / r - common) / (1 - common)
            if 0 < estimate < 1:
                own[r] = estimate
    return lambda c: own.get(c) or 1 - 1 / (c + 1) ** 2


class Model:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            own = tokens(text)
            self.words.update(own)
            self.pairs.update(zip([START, *own], own))
        self.n, d = sum(self.words.values()), shares(self.words.values())
        self.p = {w: d(c) * c / self.n for w, c in self.words.items()}
        self.unknown = 1 - math.fsum(self.p.values()) if self.n else 1.0
        self.d = shares(self.pairs.values())
        self.after = defaultdict(dict)
        for (h, w), c in self.pairs.items():
            self.after[h][w] = c
        self.alpha = {}
        for h, ws in self.after.items():
            total = sum(ws.values())
            left = math.fsum((1 - self.d(c)) * c / total for c in ws.values())
            self.alpha[h] = left / (1 - math.fsum(self.p[w] for w in ws))

    def conditional(self, w, h):
        ws = self.after.get(h, {})
        if w in ws:
            return self.d(ws[w]) * ws[w] / sum(ws.values())
        return self.alpha.get(h, 1.0) * self.p.get(w, self.unknown)

    def row(self, doc_id, text):
        own = tokens(text)
        base = math.fsum(math.log10((self.words[w] + 0.1) / (self.n + 0.1 * (len(self.words) + 1))) for w in own)
        score = math.fsum(math.log10(self.conditional(w, h)) for h, w in zip([START, *own], own))
        return (str(doc_id), held_out(doc_id), len(own), sum(w in self.words for w in own), self.n, base, score)


def check(rows, documents):
    model = Model([t for d, t in documents if not held_out(d)])
    key = lambda r: (r[0], r[2], round(r[5], 6), round(r[6], 6))
    wanted = sorted((model.row(d, t) for d, t in documents), key=key)
    found = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5] for r in found], [r[5] for r in wanted], rtol=1e-9, atol=1e-9) and np.allclose([r[6] for r in found], [r[6] for r in wanted], rtol=1e-7, atol=1e-7)
    return model


def test_tables(spark, documents):
    rows = queries.op13_katz_scores(spark, "/root/testdata/sf0.001").collect()
    model = check(rows, [tuple(r) for r in documents.select("doc_id", "text").collect()])
    for h in list(model.after)[:5] + [START, "no such history"]:
        assert abs(math.fsum(model.conditional(w, h) for w in [*model.words, "no such word"]) - 1) < 1e-9
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 5 and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(queries, "_table", lambda *_: odd)
    check(queries.op13_katz_scores(spark, "").collect(), [tuple(r) for r in odd.select("doc_id", "text").collect()])


@pytest.mark.parametrize("parts", [1, 7])
def test_blocks_and_hot_words(spark, monkeypatch, parts):
    texts = [(i, f"{prose(i, 40)} the {i % 3} THE the x{i % 5}" + " the" * (i % 40)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).cache()
    docs.count()
    monkeypatch.setattr(katz, "_hot_words", lambda rows: np.unique(np.concatenate([np.array([xxhash.xxh3_64_intdigest(b"the")], np.uint64), katz._edges()])))
    rows = katz.score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, part_chars=10**9, least_parts=parts).collect()
    check(rows, texts)


def test_small_blocks(monkeypatch):
    import pyarrow as pa

    texts = [" a  B\x0bb ", None, "c " * 50, "", "é\xa0x"]
    batch = pa.RecordBatch.from_pydict({"i": [1, 2, None, 4, 5], "t": texts, "held": [False, True, False, True, False]})
    monkeypatch.setattr(katz, "_BLOCK_BYTES", 20)
    found = list(katz.blocks(iter([batch.slice(0, 0), batch])))
    assert [b.ids for b in found] == [[1, 2], [None], [4, 5]]
    words = lambda b, codes: [[katz._START, katz._END, *b.words.to_pylist()][c] for c in codes.tolist()]
    assert words(found[0], found[0].w) == [b"a", b"b", b"b", b" ", b" "] and words(found[0], found[0].h) == [b"", b"a", b"b", b"b", b""]
    assert found[0].doc.tolist() == [0, 0, 0, 0, 1] and words(found[2], found[2].w) == [b" ", "é\xa0x".encode(), b" "]


def test_edges(spark, documents):
    nobody = F.lit(True)
    assert katz.score(documents.limit(0), F.lit(False)).count() == 0
    rows = katz.score(documents.limit(20), nobody).collect()
    assert len(rows) == 20 and all(r.train_tokens == r.n_known == 0 and r.score == r.base_score == 0 for r in rows)
    long = [(2, "word " * 1_500_000 + "x" * 500_000), (3, "word"), (4, None)]
    check(katz.score(spark.createDataFrame(long, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect(), long)


def test_discounts():
    assert np.allclose(katz.discounts([0] * 6)[1:], [1 - 1 / (r + 1) ** 2 for r in range(1, 6)])
    share = katz.discounts([1000, 300, 150, 90, 60, 42])
    assert all(0 < s < 1 for s in share[1:]) and share[1] < share[2]
    a = np.array([3, 2**40, 7, 0])
    assert (katz.unpack(katz.pack(a, "<i8"), "<i8") == a).all()

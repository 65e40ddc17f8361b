"""The search by segments stays inside tasks: parts and blocks of any number give brute force, and no row leaves a task on its way to a look-up."""

from __future__ import annotations

import numpy as np
import pytest

from helixframe.llm import hamming


def brute(codes: list[tuple[int, int]], queries: list[tuple[int, int]], k: int) -> set[tuple]:
    far = lambda x, c: ((x ^ c) & (1 << 64) - 1).bit_count()
    return {(q, n, i, d) for q, x in queries for n, (d, i) in enumerate(sorted((far(x, c), i) for i, c in codes)[:k], 1)}


@pytest.mark.parametrize("part, block", [(1 << 21, 256), (200, 3)])
def test_parts_and_blocks(spark, monkeypatch, part, block):
    monkeypatch.setattr(hamming, "PART", part)
    monkeypatch.setattr(hamming, "BLOCK", block)
    rng = np.random.default_rng(11)
    codes = [int(c) for c in rng.integers(-(1 << 63), 1 << 63, 500)]
    codes[100:140] = [codes[100] ^ (1 << int(b)) for b in rng.integers(0, 63, 40)]
    # Copies of one code among others as far from the query, with ids before and after theirs.
    codes[200:220] = [codes[7] ^ 0b111] * 10 + [codes[7] ^ (0b111 << b) for b in range(3, 13)]
    rows = list(zip((int(i) for i in rng.permutation(500)), codes))
    df = spark.createDataFrame(rows, "id long, code long")
    wanted = rows[:12] + rows[100:104]
    asked = spark.createDataFrame(wanted, "id long, code long")
    for k in (1, 10):
        got = [tuple(r) for r in hamming.top_k(df, asked, k).select("query_id", "rank", "id", "distance").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, wanted, k)


def test_nothing_generated_is_sent_to_all_tasks(spark, monkeypatch):
    plans = []

    def noted(kept):
        def run(df, *args):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
            return kept(df, *args)

        return run

    for name in ("materialize", "materialize_count"):
        if hasattr(hamming, name):
            monkeypatch.setattr(hamming, name, noted(getattr(hamming, name)))
    rng = np.random.default_rng(12)
    codes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.integers(-(1 << 63), 1 << 63, 400))], "id long, code long")
    plans.append(hamming.top_k(codes, codes.where("id % 100 = 0"), 10)._jdf.queryExecution().sparkPlan().toString())
    assert plans and not [p for p in plans if "Broadcast" in p and "Generate" in p]

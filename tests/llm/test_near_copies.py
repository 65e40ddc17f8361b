"""The near-dedup stage against brute-force Jaccard similarity of 5-word shingles."""

from __future__ import annotations

import random

WORDS = "the of and contig scaffold link bundle read mate pair gap reads mapped edge node orient ground truth cover depth mask repeat".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(rng.randint(0, 999))]) for _ in range(n))


def shingles(text: str, k: int = 5) -> frozenset:
    words = text.encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_leaders(rows: list[tuple]) -> set:
    """Of (key, text), the smallest key of each group."""
    sets = [(d, shingles(t or "")) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b) > 0):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d for d in root if find(d) == d}


def near_rows() -> list[tuple]:
    rng = random.Random(8)
    rows = []
    for base in range(40):
        words = prose(1000 + base, 300).split()
        for copy, edits in enumerate((0, 2, 5, 8, 12, 20)):
            mine = list(words)
            for at in rng.sample(range(300), edits):
                mine[at] = f"other{rng.randint(0, 9999)}"
            rows.append((base * 10 + copy, " ".join(mine)))
    return rows + [(900, None), (901, " "), (902, "two words"), (903, "Two  WORDS")]


def stage(spark, rows):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return dict(p.STAGES)["SimHash near-dedup"](spark, docs, "").collect()


def test_near_copies_go(spark):
    rows = near_rows()
    wanted = brute_leaders(rows)
    got = [r.doc_id for r in stage(spark, rows)]
    assert set(got) == wanted and len(got) == len(wanted) < len(rows) - 80


def test_texts_with_one_id_stay(spark):
    first, second = prose(501, 200), prose(502, 200)
    got = [(r.doc_id, r.text) for r in stage(spark, [(1, first), (1, second), (1, first), (2, second)])]
    assert sorted(got) == sorted([(1, first), (1, second)])


def test_whole_tables(spark, docs):
    """Exactly the brute-force leaders, with null and repeated ids."""
    import corpus_pipeline as p

    rows = {(r.doc_id is None, r.doc_id or 0, r.h): r.text for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    got = sorted((r.doc_id is None, r.doc_id or 0, r.h) for r in dict(p.STAGES)["SimHash near-dedup"](spark, docs, "").selectExpr("doc_id", "xxhash64(text) AS h").collect())
    assert got == sorted(brute_leaders(list(rows.items())))


def test_fingerprints_alone_link_too(spark):
    """Candidates that only anchors give are compared as well."""
    from helixframe.llm import nearcopies

    texts = spark.createDataFrame([(i, t) for i, t in near_rows()], "row long, text string")
    with_anchors = set(map(tuple, nearcopies.near_copies(texts, "row").collect()))
    assert with_anchors == set(map(tuple, nearcopies.near_copies(texts, "row", threshold=0).collect()))

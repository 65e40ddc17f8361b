"""Documents with the largest and the smallest id beside documents without one."""

from __future__ import annotations

from helixframe.llm import chunks, linededup

from tests.llm.conftest import prose

LARGEST, SMALLEST = (1 << 63) - 1, -(1 << 63)


def frame(spark, ids, text):
    return spark.createDataFrame([(i, text, "en", "s") for i in ids], "doc_id long, text string, lang string, source string")


def test_lines(spark):
    line = "one line that all of them hold"
    for ids, keeper in (([LARGEST, None], LARGEST), ([None, SMALLEST], SMALLEST), ([LARGEST, SMALLEST, None, 0], SMALLEST), ([None, None], None)):
        rows = linededup.deduplicate_lines(frame(spark, ids, line)).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        assert all(r.n_dropped == (r.doc_id != keeper) for r in rows)


def test_deletion_of_rows_without_an_id(spark):
    docs = frame(spark, [LARGEST, None, 5], "one line that all of them hold")
    index = linededup.LineIndex.empty(spark).insert(linededup.line_references(docs, "doc_id", "text", 10))
    assert sorted(str(r.doc_id) for r in index.surplus().collect()) == [str(LARGEST), "None"]
    index = index.delete(spark.createDataFrame([(None,), (5,)], "doc_id long"))
    assert [tuple(r) for r in index.counts.select("n", "named", "first_id", "last_id").collect()] == [(1, 1, LARGEST, LARGEST)] and index.surplus().count() == 0


def test_passages(spark):
    for ids, keeper in (([LARGEST, None], LARGEST), ([SMALLEST, LARGEST, None], SMALLEST)):
        rows = chunks.repeated_passages(frame(spark, ids, prose(7, 200))).collect()
        assert {r.doc_id: r.kept_doc_ids for r in rows} == {i: [keeper] for i in ids if i != keeper}

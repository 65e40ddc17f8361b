"""The quality limits on labelled documents."""

from __future__ import annotations

from helixframe.llm import quality, queries
from helixframe.llm.tokens import RankTokenizer


def test_junk_goes_and_clean_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    verdicts = quality.apply_rules(docs, *queries._fertility()).where("not base_failed")
    rows = verdicts.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("quality", "kept").collect()
    kept = {q: [r.kept for r in rows if r.quality == q] for q in (0, 1)}
    assert len(kept[0]) > 10 and sum(kept[0]) < 0.2 * len(kept[0]) and sum(kept[1]) > 0.97 * len(kept[1])


def test_script_of_most_letters():
    hebrew, hindi, thai, armenian = "שלום עולם " * 20, "नमस्ते दुनिया " * 20, "สวัสดีชาวโลก " * 20, "բարեւ աշխարհ " * 20
    for text in (hebrew, hindi, thai, armenian):
        assert quality.script_of(text + "see https://example.org by Ann") == "other"
        assert quality.script_of(text[:20] + "and this is a long English sentence with many more letters than that") == "latin"
    assert [quality.script_of(t) for t in ("plain", "été", "漢字 x", "12 😀", "мир z", "سلام z", "Ωμέγα z")] == ["latin", "latin", "cjk", "other", "cyrillic", "arabic", "greek"]


def test_broken_characters():
    """Alone among single bytes, those of ASCII are whole characters."""
    bpe = RankTokenizer(*queries._fertility()[1])
    broken = bpe.broken()
    assert len(broken) == 50257 and (bpe.byte_lengths[broken] > 0).all() and broken[bpe.byte_lengths == 1].sum() == 128
    assert not broken[bpe.encode("plain été мир<|endoftext|>")].any() and broken[bpe.encode("😀")].any()


def test_text_of_another_script_stays(spark):
    words = [f"{a}{b}{c}" for a in "אבגדה" for b in "וזחטי" for c in "כלמנס"]
    rows = spark.createDataFrame([(1, " ".join(words) + " Ann", None)], "doc_id long, text string, lang string")
    got = quality.apply_rules(rows, *queries._fertility()).first()
    assert (got.base_failed, got.script, got.kept) == (False, "other", True)

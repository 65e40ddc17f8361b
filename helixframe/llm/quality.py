"""Quality rules: base text statistics and tokeniser fertility per language or script."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import RankTokenizer

#: Fixed values.  Bands of (characters per token least, most; byte-fallback share most; token entropy in bits least)
#: under the public 32k BPE vocabulary with byte fallback, and under the public byte-level BPE of many languages.  A
#: language without a band takes that of its script.  For the four languages, the least characters per token and entropy
#: are the first 400th of the clean documents with even ids that pass the base rules at sf0.1, cut to two decimals.  No
#: labelled document has any fallback, so its limit is not fitted.
BANDS = {
    "en": ((2.04, 8.0, 0.05, 5.75), (2.09, 8.0, 0.05, 5.77)),
    "de": ((2.06, 8.0, 0.05, 5.79), (2.17, 8.0, 0.05, 5.83)),
    "fr": ((1.73, 8.0, 0.05, 5.73), (1.87, 8.0, 0.05, 5.74)),
    "es": ((1.80, 8.0, 0.05, 5.80), (1.92, 8.0, 0.05, 5.74)),
    "latin": ((1.5, 8.0, 0.05, 3.0), (1.5, 8.0, 0.10, 3.0)),
    "greek": ((0.8, 6.0, 0.30, 3.0), (0.8, 8.0, 0.30, 3.0)),
    "cyrillic": ((1.0, 7.0, 0.20, 3.0), (1.0, 8.0, 0.20, 3.0)),
    "arabic": ((0.6, 5.0, 0.40, 3.0), (0.6, 8.0, 0.40, 3.0)),
    "cjk": ((0.3, 3.0, 0.70, 3.0), (0.4, 6.0, 0.70, 3.0)),
    "other": ((0.2, 8.0, 1.00, 2.0), (0.2, 8.0, 1.00, 2.0)),
}
#: Fixed values.  Code point ranges by which the script of most letters is told.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏ",
    "greek": "Ͱ-Ͽ",
    "cyrillic": "Ѐ-ԯ",
    "arabic": "؀-ۿ",
    "cjk": "぀-ヿ㐀-鿿가-힯",
}
_SCRIPTS = {name: re.compile(f"[{span}]+") for name, span in SCRIPTS.items()}
_KNOWN = re.compile(f"[{''.join(SCRIPTS.values())}]+")
_SYMBOLS = "#*$%&|<>"

RULES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "script string, chars_per_token double, fallback_share double, token_entropy double, "
    "rank_chars_per_token double, rank_fallback_share double, rank_token_entropy double, kept boolean"
)


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words in order of appearance, and the place among them of every word."""
    distinct = list(dict.fromkeys(words))
    places = dict(zip(distinct, range(len(distinct))))
    return distinct, np.fromiter(map(places.__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray, k: int) -> int:
    """Words inside a 3-word window that occurs twice or more, its first occurrence included; ``ids`` are word numbers below ``k``."""
    n = len(ids)
    if n < 4:
        return 0
    if k > 2_000_000:  # three such numbers would not fit 63 bits: number the pairs first
        _, pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        windows = pairs[:-1].astype(np.int64) * k + ids[2:]
    else:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return again


def script_of(text: str) -> str:
    """The script of most letters; letters of none of the known ones count as ``other``, and ASCII is ``latin``."""
    if text.isascii():
        return "latin"
    counts = {name: sum(map(len, p.findall(text))) for name, p in _SCRIPTS.items()}
    counts["other"] = sum(map(str.isalpha, _KNOWN.sub("", text)))
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


class Fertility:
    """Characters per token, byte-fallback share and token entropy over the words of a text, with a bounded word cache.

    Every vocabulary sees each word by itself, the byte-level one with a space
    before it.  There, a fallback is a token that is no whole characters.
    """

    def __init__(self, model_path: str, ranks: tuple[str, str] | None, max_words: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._encoders = [lambda words: model.encode(words, num_threads=1)]
        self._fallback = [np.array([model.is_byte(i) for i in range(model.get_piece_size())])]
        if ranks:
            bpe = RankTokenizer(*ranks)
            self._encoders.append(lambda words: [bpe.tokens(" " + w) for w in words])
            self._fallback.append(bpe.broken())
        self._ids: dict[bytes, tuple[bytes, ...]] = {}
        self._room = max_words

    def __call__(self, words: list[bytes], counts: np.ndarray, word_chars: int) -> list[tuple[float, float, float]]:
        """One triple for each vocabulary, of different words and how often each occurs."""
        parts = list(map(self._ids.get, words))
        missing = [i for i, p in enumerate(parts) if p is None]
        texts = [words[i].decode() for i in missing]
        encoded = [encode(texts) for encode in self._encoders]
        hits = [p for p in parts if p is not None]
        hit_counts, miss_counts = np.delete(counts, missing), counts[missing]
        triples = []
        for v, (fallback, lists) in enumerate(zip(self._fallback, encoded)):
            column = [p[v] for p in hits]
            lengths = np.fromiter(map(len, column), np.int64, len(column)) // 2
            more = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.concatenate([np.frombuffer(b"".join(column), "<u2"), np.fromiter(chain.from_iterable(lists), "<u2", int(more.sum()))])
            often = np.concatenate([np.repeat(hit_counts, lengths), np.repeat(miss_counts, more)])
            triples.append(self._measure(ids, often, fallback, word_chars))
        for i, *ids in zip(missing, *encoded):
            if len(self._ids) >= self._room:
                break
            if len(words[i]) < 64:
                self._ids[words[i]] = tuple(np.array(x, "<u2").tobytes() for x in ids)
        return triples

    @staticmethod
    def _measure(ids: np.ndarray, often: np.ndarray, fallback: np.ndarray, word_chars: int) -> tuple[float, float, float]:
        """The triple of token ids that occur ``often`` as many times."""
        if not len(ids):
            return 0.0, 0.0, 0.0
        order = np.argsort(ids, kind="stable")
        first = np.concatenate([[0], np.flatnonzero(np.diff(ids[order])) + 1])
        tokens = int(often.sum())
        share = np.add.reduceat(often[order], first) / tokens
        return word_chars / tokens, float(often[fallback[ids]].sum() / tokens), float(-(share * np.log2(share)).sum())


#: Limits of one vocabulary, and those of a language or script under the two.
Band = tuple[float, float, float, float]
Bands = dict[str, tuple[Band, Band]]


class Rules:
    """The rules with their parameters; ``measure`` gives a row of ``RULES`` for one document."""

    def __init__(self, model_path: str, ranks: tuple[str, str] | None, bands: Bands | None, min_words: int, max_repeat_percent: int):
        self.model_path, self.ranks, self.bands = model_path, ranks, BANDS | (bands or {})
        self.min_words, self.max_repeat_percent = min_words, max_repeat_percent

    def fertility(self) -> Fertility:
        return Fertility(self.model_path, self.ranks)

    def measure(self, fertility: Fertility, doc_id: int | None, text: str, lang: str | None) -> tuple:
        words = text.encode().split()  # of bytes: splits at exactly the six characters
        distinct, ids = numbered(words)
        word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        repeat = repeated_words(ids, len(distinct))
        failed = len(words) < self.min_words or 100 * repeat > self.max_repeat_percent * len(words)
        script = script_of(text)
        measured = fertility(distinct, np.bincount(ids, minlength=len(distinct)), word_chars)
        inside = all(
            least <= per_token <= most and share <= fallback and bits >= entropy
            for (least, most, fallback, entropy), (per_token, share, bits) in zip(self.bands.get(lang) or self.bands[script], measured)
        )
        flat = [x for triple in measured for x in triple] + [None] * (6 - 3 * len(measured))
        return doc_id, len(words), word_chars, sum(map(text.count, _SYMBOLS)), duplicate_lines(text), repeat, failed, script, *flat, not failed and inside

    def batch(self, fertility: Fertility, batch: pa.RecordBatch, id_col: str, text_col: str, lang_col: str) -> list[tuple]:
        ids, texts, langs = (batch.column(c) for c in (id_col, text_col, lang_col))
        return [self.measure(fertility, i.as_py(), t.as_py() or "", g.as_py()) for i, t, g in zip(ids, texts, langs)]


def apply_rules(
    docs: DataFrame,
    model_path: str,
    ranks: tuple[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    bands: Bands | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Measure every document and judge it (``RULES``), one row for each input row.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` percent of them in repeated 3-word windows.  A
    document is kept if that does not hold and its fertility under every
    vocabulary lies inside the band of its language, else of the script of most
    of its letters.  ``model_path`` is a piece model and ``ranks`` the path and
    split pattern of a rank file, each of at most 65,536 tokens; without
    ``ranks`` the pieces alone decide, and the ``rank_`` columns are null.
    Nothing is shuffled.

    A null text has no words and fails; a null language means the script
    decides; null or repeated ids are kept row by row; other columns are
    ignored; an empty table gives no rows.  Of scripts with as many letters the
    first in ``SCRIPTS`` counts.  A text of any length is measured whole in one
    task.
    """
    rules = Rules(model_path, ranks, bands, min_words, max_repeat_percent)
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    out = pa.schema([(c, types[t]) for c, t in (x.split() for x in RULES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = rules.fertility()
        for batch in batches:
            if rows := rules.batch(fertility, batch, "doc_id", "text", "lang"):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).mapInArrow(run, RULES)


def filter_documents(
    docs: DataFrame,
    model_path: str,
    ranks: tuple[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    bands: Bands | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """The rows of ``docs`` that :func:`apply_rules` keeps, with all their columns, in one pass without a shuffle."""
    rules = Rules(model_path, ranks, bands, min_words, max_repeat_percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = rules.fertility()
        for batch in batches:
            yield batch.filter(pa.array([row[-1] for row in rules.batch(fertility, batch, id_col, text_col, lang_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

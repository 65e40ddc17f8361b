"""Katz backoff: a bigram model of a corpus, partitioned by history, and the log probability of every text under it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..tables import materialize

#: Fixed values of the base score, and the highest count that is discounted by Good and Turing's estimate.
BASE_ADD, TURING_MOST = 0.1, 5
#: A task codes texts together that have so many bytes; a larger one is alone.
_BLOCK_BYTES = 8 << 20
#: Histories with a larger share of the tokens are split by the word that follows; there are at most so many.
_HOT = 256

_WORDS = "part int, words binary, counts binary, needs binary, owners binary"
_VOCABULARY = "part int, words binary, counts binary, tokens bigint, distinct bigint, often array<bigint>, rest double, hot array<struct<place:int,n:bigint>>"
_GRAMS = "part int, block bigint, words binary, h binary, w binary, doc binary, n binary, ids binary, flags binary"
_EVALUATED = (
    "part int, block bigint, docs binary, ints binary, sums binary, ids binary, flags binary, "
    "often array<bigint>, blocks array<bigint>, histories binary, pending binary, hot array<struct<place:int,stats:array<double>>>"
)
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def pack(values: np.ndarray, dtype: str) -> bytes:
    """First the lowest bytes of all values, then the next ones, so that high zeros are long runs; compressed."""
    a = np.ascontiguousarray(values, dtype)
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def discounts(often: list[int]) -> np.ndarray:
    """The share of a count r = 0 .. 5 that its n-grams keep, of ``often[r - 1]`` n-grams with count r = 1 .. 6.

    Where the counts of counts give no share between 0 and 1, it is that of
    higher counts, :func:`kept`; some mass is left in every case.
    """
    share = kept(np.arange(TURING_MOST + 1))
    first, last = often[0], often[TURING_MOST]
    common = (TURING_MOST + 1) * last / first if first else 1.0
    for r in range(1, TURING_MOST + 1):
        if common < 1 and often[r - 1]:
            estimate = ((r + 1) * often[r] / often[r - 1] / r - common) / (1 - common)
            if 0 < estimate < 1:
                share[r] = estimate
    return share


def kept(counts: np.ndarray) -> np.ndarray:
    """The share that n-grams of counts above 5 keep."""
    return 1 - 1 / (counts + 1.0) ** 2


def discounted(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= TURING_MOST, share[np.minimum(counts, TURING_MOST)], kept(counts))


#: No words, so they stand for a text's start and end; in every block they are the first two.
_START, _END = b"", b" "


class Block:
    """Texts (doc_id, text, held out) coded together: numbers of history, word and document of every token, and the words."""

    def __init__(self, rows: pa.RecordBatch):
        self.ids, self.held = rows.column(0).to_pylist(), np.array(rows.column(2).to_pylist(), bool)
        texts = rows.column(1).fill_null("")
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # gives empty pieces at the ends of a text
        flat, offsets = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        real = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        counts = np.diff(before[offsets])
        coded = flat.filter(real).dictionary_encode()
        n = len(self.ids)
        self.doc = np.repeat(np.arange(n, dtype=np.int32), counts + 1)
        self.w = np.ones(len(self.doc), np.int32)
        ends = np.cumsum(counts + 1) - 1
        inner = np.ones(len(self.doc), bool)
        inner[ends] = False
        self.w[inner] = coded.indices.to_numpy() + 2
        self.h = np.concatenate([[0], self.w[:-1]]).astype(np.int32)
        self.h[ends[:-1] + 1] = 0
        self.words = coded.dictionary.cast(pa.binary())

    def hashes(self) -> np.ndarray:
        import xxhash

        words = [_START, _END, *self.words.to_pylist()]
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _BLOCK_BYTES, "right")))
            yield Block(batch.slice(at, n))
            at += n


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _parts(hashes: np.ndarray, h: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of each bigram: its history's, or its word's where the history is hot."""
    home = (hashes % np.uint64(parts)).astype(np.int32)
    return np.where(np.isin(hashes, hot)[h], home[w], home[h])


def _find(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value, or -1."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def _code_words(hot: np.ndarray, parts: int):
    schema = _arrow(_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, h, w = block.hashes(), block.h, block.w
            counts = np.bincount(w, ~block.held[block.doc], len(hashes)).astype(np.int64)
            home = (hashes % np.uint64(parts)).astype(np.int64)
            present = np.flatnonzero(np.bincount(w, minlength=len(hashes)))
            needed, _ = _distinct(np.concatenate([w.astype(np.int64) * parts + _parts(hashes, h, w, hot, parts), present * parts + home[present]]))
            owner, need = needed // parts, needed % parts
            for p in range(parts):
                own = present[home[present] == p]
                place = np.full(len(hashes), -1)
                place[own] = np.arange(len(own))
                at = place[owner] >= 0
                if len(own):
                    yield pa.RecordBatch.from_pylist(
                        [{"part": p, "words": pack(hashes[own], "<u8"), "counts": pack(counts[own], "<i8"), "needs": pack(need[at], "<u4"), "owners": pack(place[owner[at]], "<u4")}], schema
                    )

    return run


def _count_words(hot: np.ndarray):
    """The words of one part from all blocks: their counts, sent to every part that needs them."""
    schema = _arrow(_VOCABULARY)

    def run(table: pa.Table) -> pa.Table:
        columns = {c: [x.as_py() for x in table.column(c)] for c in ("words", "counts", "needs", "owners")}
        each = [unpack(x, "<u8") for x in columns["words"]]
        words, place = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.bincount(place, np.concatenate([unpack(x, "<i8") for x in columns["counts"]]), len(words)).astype(np.int64)
        offsets = np.cumsum([0, *map(len, each)])
        owners = np.concatenate([place[unpack(x, "<u4").astype(np.int64) + o] for x, o in zip(columns["owners"], offsets)])
        needs = np.concatenate([unpack(x, "<u4") for x in columns["needs"]]).astype(np.int64)
        pairs = np.unique((needs << 32) + owners)
        pairs = pairs[counts[pairs & 0xFFFFFFFF] > 0]
        targets, starts = np.unique(pairs >> 32, return_index=True)
        seen = counts[counts > 0]
        often = np.bincount(np.minimum(seen, TURING_MOST + 2), minlength=TURING_MOST + 3)[1 : TURING_MOST + 2]
        large = seen[seen > TURING_MOST].astype(float)
        at = _find(words, hot)
        rows = [{
            "tokens": int(seen.sum()), "distinct": len(seen), "often": often.tolist(), "rest": float((large * (1 - kept(large))).sum()),
            "hot": [{"place": i, "n": int(counts[a])} for i, a in enumerate(at.tolist()) if a >= 0],
        }]
        for target, own in zip(targets.tolist(), np.split(pairs & 0xFFFFFFFF, starts[1:])):
            rows.append({"part": target, "words": pack(words[own], "<u8"), "counts": pack(counts[own], "<i8")})
        return pa.Table.from_pylist(rows, schema)

    return run


def _code_grams(hot: np.ndarray, parts: int):
    schema = _arrow(_GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 33
        for number, block in enumerate(blocks(batches)):
            hashes, held = block.hashes(), block.held
            # A bigram of a document is one number of at most 64 bits: 8 MB have at most 2**22 words and 2**23 documents.
            bits, low = int(len(hashes) - 1).bit_length(), int(len(block.ids) - 1).bit_length()
            key, n = _distinct((block.h.astype(np.uint64) << np.uint64(bits + low)) | (block.w.astype(np.uint64) << np.uint64(low)) | block.doc.astype(np.uint64))
            del block.h, block.w, block.doc
            h, w, doc = ((key >> np.uint64(shift) & np.uint64(2**width - 1)).astype(np.int32) for shift, width in ((bits + low, bits), (low, bits), (0, low)))
            part = _parts(hashes, h, w, hot, parts)
            missing = np.array([i is None for i in block.ids])
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=parts))
            for p, own in enumerate(np.split(order, ends[:-1])):
                row = {"part": p, "block": task + number}
                if p == number % parts:
                    row |= {"ids": pack(np.array([i or 0 for i in block.ids], np.int64), "<i8"), "flags": (held + 2 * missing).astype(np.uint8).tobytes()}
                if len(own) or "ids" in row:
                    used = np.unique(np.concatenate([h[own], w[own]]))
                    used = used[np.argsort(hashes[used])]
                    place = np.zeros(len(hashes), np.int64)
                    place[used] = np.arange(len(used))
                    row |= {"words": pack(hashes[used], "<u8"), "h": pack(place[h[own]], "<u4"), "w": pack(place[w[own]], "<u4"), "n": pack(n[own], "<u4")}
                    row |= {"doc": pack(doc[own] * 2 + held[doc[own]], "<u4")}
                    yield pa.RecordBatch.from_pylist([row], schema)

    return run


class Unigrams:
    """The lower order: discounted shares of the known words; the rest is the unknown word's."""

    def __init__(self, tokens: int, distinct: int, often: list[int], rest: float):
        self.tokens, self.distinct, self.share = tokens, distinct, discounts(often)
        left = sum((1 - self.share[r]) * r * often[r - 1] for r in range(1, TURING_MOST + 1)) + rest
        self.unknown = left / tokens if tokens else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.share) / max(self.tokens, 1), self.unknown)


def _evaluate(unigrams: Unigrams, hot: np.ndarray, hot_counts: np.ndarray):
    """All bigrams of one part: sums for each document, and what backoff weights need once the discounts are known.

    The discount of a count is the same for all bigrams, so a document's score
    is told by sums that leave it out and by how many tokens have each count.
    """
    schema = _arrow(_EVALUATED)

    def run(grams: pa.Table, vocabulary: pa.Table) -> pa.Table:
        if not grams.num_rows:
            return pa.Table.from_pylist([], schema)
        pa.default_memory_pool().release_unused()
        rows = grams.select(["part", "block", "ids", "flags"]).to_pylist()
        packed = {c: grams.column(c).combine_chunks() for c in ("words", "h", "w", "doc", "n")}
        column = lambda c, i, dtype="<u4": unpack(packed[c][i].as_py(), dtype)
        known = [(unpack(w.as_py(), "<u8"), unpack(c.as_py(), "<i8")) for w, c in zip(vocabulary.column("words"), vocabulary.column("counts"))]
        counted = np.concatenate([np.zeros(0, np.uint64), *(k[0] for k in known)])
        order = np.argsort(counted)
        counted, counts = counted[order], np.concatenate([np.zeros(0, np.int64), *(k[1] for k in known)])[order]
        # Words and documents are numbered inside the part, in 32 bits.
        each = [column("words", i, "<u8") for i in range(len(rows))]
        words, places = np.unique(np.concatenate(each), return_inverse=True)
        places = np.split(places.astype(np.int32), np.cumsum(list(map(len, each)))[:-1])
        at = _find(counted, words)
        word_counts = np.where(at >= 0, counts[at] if len(counted) else 0, 0)
        word_p = unigrams.p(word_counts)
        ends = np.cumsum([0, *(zstandard.frame_content_size(packed["n"][i].as_py()) // 4 for i in range(len(rows)))])
        keys, doc, n, trained = (np.empty(ends[-1], t) for t in (np.uint64, np.int32, np.int32, bool))
        offsets = [0]
        for i, own in enumerate(places):
            here = slice(ends[i], ends[i + 1])
            keys[here] = own[column("h", i)]
            keys[here] <<= np.uint64(32)
            keys[here] |= own[column("w", i)].astype(np.uint64)
            d = column("doc", i)
            doc[here] = (d >> 1).astype(np.int32) + np.int32(offsets[-1])
            trained[here] = (d & 1) == 0
            n[here] = column("n", i)
            offsets.append(offsets[-1] + int(d.max() >> 1) + 1 if len(d) else offsets[-1])
        order = np.argsort(keys)
        keys, doc, n, trained = keys[order], doc[order], n[order], trained[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        h, w = (keys[starts] >> np.uint64(32)).astype(np.int32), (keys[starts] & np.uint64(0xFFFFFFFF)).astype(np.int32)
        del keys
        pair_counts = np.add.reduceat(n * trained, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        del trained
        pair_words, pair_p = word_counts[w], word_p[w]
        # Histories: of a hot one, this part has some of the words that follow.
        names, history = np.unique(h, return_inverse=True)
        place = _find(hot, words[names])
        totals = np.where(place >= 0, hot_counts[place] if len(hot) else 0, np.bincount(history, pair_counts, len(names)).astype(np.int64))
        large = pair_counts > TURING_MOST
        c = np.maximum(pair_counts, 1).astype(float)
        stats = np.column_stack(
            [place, totals]
            + [np.bincount(history, pair_counts == r, len(names)) for r in range(1, TURING_MOST + 1)]
            + [np.bincount(history, large * c * (1 - kept(c)), len(names)), np.bincount(history, (pair_counts > 0) * pair_p, len(names))]
        )
        seen = np.log10(c) - np.log10(np.maximum(totals[history], 1)) + np.where(large, np.log10(kept(c)), 0)
        spread = lambda x: np.repeat(x, sizes)  # noqa: E731  from bigrams to the documents that have them
        add = lambda x: np.bincount(doc, x, offsets[-1])
        share = lambda x: add(spread(x) * n)
        ints = [share((pair_words > 0).astype(np.int32)), add(n)] + [share((pair_counts == r).astype(np.int32)) for r in range(1, TURING_MOST + 1)]
        sums = [share(np.log10(pair_words + BASE_ADD)), share(np.where(pair_counts > 0, seen, np.log10(pair_p)))]
        out = []
        for r, a, b in zip(rows, offsets, offsets[1:]):
            own = np.flatnonzero(ints[1][a:b])
            out.append({
                "part": r["part"], "block": r["block"], "docs": pack(own, "<u4"), "ints": pack(np.concatenate([x[a:b][own] for x in ints]), "<u4"),
                "sums": pack(np.concatenate([x[a:b][own] for x in sums]), "<f8"), "ids": r["ids"], "flags": r["flags"],
            })
        backs_off = spread((pair_counts == 0) & (totals[history] > 0))
        used, at = np.unique(spread(history)[backs_off], return_inverse=True)
        late = doc[backs_off]
        block = np.searchsorted(offsets, late, "right") - 1
        pending = np.concatenate([at, block, late - np.array(offsets)[block], n[backs_off]])
        out.append({
            "part": rows[0]["part"], "often": [int((pair_counts == r).sum()) for r in range(1, TURING_MOST + 2)], "blocks": [r["block"] for r in rows],
            "histories": pack(stats[used].ravel(), "<f8"), "pending": pack(pending, "<u4"),
            "hot": [{"place": int(s[0]), "stats": s[2:].tolist()} for s in stats[place >= 0]],
        })
        return pa.Table.from_pylist(out, schema)

    return run


def weights(stats: np.ndarray, totals: np.ndarray, share: np.ndarray, unknown: float) -> np.ndarray:
    """Backoff weights of histories: the mass that their words leave over that of all words that don't follow them."""
    r = np.arange(1, TURING_MOST + 1)
    left = (stats[:, :TURING_MOST] * r * (1 - share[1:])).sum(1) + stats[:, TURING_MOST]
    return left / np.maximum(totals, 1) / np.maximum(1 - stats[:, TURING_MOST + 1], unknown)


def _resolve(share: np.ndarray, unknown: float, hot_weights: np.ndarray):
    """The tokens of one part that back off, once the weights can be told."""
    schema = _arrow(_EVALUATED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stats = unpack(row["histories"], "<f8").reshape(-1, TURING_MOST + 4)
                place = stats[:, 0].astype(int)
                alpha = np.where(place >= 0, hot_weights[place], weights(stats[:, 2:], stats[:, 1], share, unknown))
                at, block, doc, n = unpack(row["pending"], "<u4").astype(np.int64).reshape(4, -1)
                keys, inverse = np.unique((block << 32) + doc, return_inverse=True)
                more = np.bincount(inverse, np.log10(alpha)[at] * n, len(keys))
                out = []
                for b in np.unique(keys >> 32).tolist():
                    own = (keys >> 32) == b
                    out.append({"part": row["part"], "block": row["blocks"][b], "docs": pack(keys[own] & 0xFFFFFFFF, "<u4"), "sums": pack(more[own], "<f8")})
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _finish(unigrams: Unigrams, share: np.ndarray):
    """The rows of one block from all parts."""
    schema = _arrow(SCORED)
    most = unigrams.tokens + BASE_ADD * (unigrams.distinct + 1)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["ints"] is None))
        ids = next(unpack(r["ids"], "<i8") for r in rows if r["ids"] is not None)
        flags = next(np.frombuffer(r["flags"], np.uint8) for r in rows if r["flags"] is not None)
        ints, base, score = np.zeros((TURING_MOST + 2, len(ids)), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for r in rows:
            docs = unpack(r["docs"], "<u4")
            if r["ints"] is None:
                score[docs] += unpack(r["sums"], "<f8")
            else:
                ints[:, docs] += unpack(r["ints"], "<u4").reshape(TURING_MOST + 2, len(docs))
                both = unpack(r["sums"], "<f8").reshape(2, -1)
                base[docs] += both[0]
                score[docs] += both[1]
        known, tokens, *often = ints
        score += sum(k * np.log10(s) for k, s in zip(often, share[1:]))
        columns = [
            pa.array(ids, mask=(flags & 2) > 0), pa.array((flags & 1) > 0), pa.array(tokens), pa.array(known),
            pa.array(np.full(len(ids), unigrams.tokens)), pa.array(base - tokens * np.log10(most)), pa.array(score),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", part_chars: int = 20 << 20, least_parts: int = 32) -> DataFrame:
    """The log10 probability of every text under a Katz bigram model of those that are not ``held_out`` (``SCORED``).

    A text's tokens are its words in ASCII lower case and one end.  After a
    history h, a word that follows it c times has ``d(c) * c / C(h)``; any other
    backs off to the history's weight times its own probability, ``d(c) * c /
    N``, or to the rest of that for words not known.  d is Good and Turing's
    discount up to counts of 5 (:func:`discounts`).  The weight is what the
    words after h leave, over the probability of all words that don't follow h,
    so each history's probabilities sum to 1.  An unseen history has weight 1.
    The base score adds 0.1 to the count of every word and of the unknown one.

    Three passes over the texts, in blocks of about 8 MB: hot
    histories from one row in 64 (they decide only where rows go); words; and
    bigrams.  A block sends each part its different bigrams of each document in
    one row of packed numbers, so a frequent bigram is combined before it moves.
    Parts are hashes of the history, or of the word where the history is hot,
    one for every ``part_chars`` characters.  Word counts go to the parts whose
    bigrams need them.  A part answers with sums for each document, so no table
    of tokens is ever joined; counts of counts, and sums of hot histories, at
    most 256, go through the driver.

    Null texts are empty; null or repeated ids are rows of their own, and repeated
    rows count as often as they occur; other columns are ignored; without a
    training row all words are the unknown one; an empty table gives no rows.
    A text is split whole in one task, 100 bytes or so a word.  The rows must
    come in a fixed order, as they do from a table: write out what does not.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False)).cast("boolean").alias("held")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), held)
    parts = max(least_parts, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // part_chars + 1)
    hot = _hot_words(rows)
    vocabulary = materialize(rows.mapInArrow(_code_words(hot, parts), _WORDS).groupBy("part").applyInArrow(_count_words(hot), _VOCABULARY), "vocabulary")
    told = vocabulary.where("tokens is not null")
    rare = [F.coalesce(F.sum(F.col("often")[r]), F.lit(0)) for r in range(TURING_MOST + 1)]
    tokens, distinct, rest, *often = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("rest"), F.lit(0.0)), *rare).first()
    unigrams = Unigrams(tokens, distinct, often, rest)
    hot_counts = np.zeros(len(hot), np.int64)
    for r in told.select(F.inline("hot")).groupBy("place").agg(F.sum("n").alias("n")).collect():
        hot_counts[r.place] = r.n
    start, end = _find(hot, _edges())
    hot_counts[start] = hot_counts[end]  # a text that is learnt from has one of each
    grams = rows.mapInArrow(_code_grams(hot, parts), _GRAMS)
    needed = vocabulary.where("part is not null").select("part", "words", "counts")
    evaluated = materialize(grams.groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(_evaluate(unigrams, hot, hot_counts), _EVALUATED), "evaluated")
    summary = evaluated.where("block is null")
    share = discounts(list(summary.agg(*rare).first()))
    stats = np.zeros((len(hot), TURING_MOST + 2))
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(TURING_MOST + 2)]
    for r in summary.select(F.inline("hot")).groupBy("place").agg(*sums).collect():
        stats[r.place] = r[1:]
    hot_weights = weights(stats, hot_counts, share, unigrams.unknown)
    resolved = summary.mapInArrow(_resolve(share, unigrams.unknown, hot_weights), _EVALUATED)
    answers = evaluated.where("block is not null").union(resolved).select("part", "block", "docs", "ints", "sums", "ids", "flags")
    return answers.groupBy("block").applyInArrow(_finish(unigrams, share), SCORED)


def _edges() -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(x) for x in (_START, _END)], np.uint64)


def _hot_words(rows: DataFrame) -> np.ndarray:
    """Hashes of the start, the end and the most frequent words of one row in 64, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            counts = np.bincount(block.w, minlength=len(block.words) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(block.hashes().view(np.int64)), pa.array(counts)], names=["word", "n"])

    counted = materialize(rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(64)) == 0).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "sampled-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = [r.word for r in counted.where(F.col("n") * (_HOT - 2) >= total).where("n > 0").collect()]
    return np.unique(np.concatenate([np.array(found, np.int64).view(np.uint64), _edges()]))

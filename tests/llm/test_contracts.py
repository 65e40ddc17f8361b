"""The contract queries and the stages against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import chunks, linededup, mixing, packing, quality, queries, secrets, simhash
from helixframe.llm.tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\v\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reading(monkeypatch, df):
    """The registered queries read ``df`` in place of the table."""
    monkeypatch.setattr(queries, "_table", lambda *_: df)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(spark, docs, monkeypatch):
    reading(monkeypatch, docs)
    check_pieces(queries.op2_packing(spark, "").collect(), docs.collect())


def check_pieces(rows, documents):
    """Every id of every document lies in one piece, and sequences are gapless and unpadded."""
    t = tokenizer()
    wanted = defaultdict(list)
    for r in documents:
        wanted[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, 1])
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.doc_tokens, r.start, r.length, r.ids_crc32))
    assert set(got) == set(wanted)
    for doc_id, versions in wanted.items():
        expected = Counter()
        for ids in versions:
            data = np.array(ids, "<u4").tobytes()
            assert any((n, s, k, zlib.crc32(data[4 * s : 4 * (s + k)])) in got[doc_id] for n, s, k, _ in got[doc_id])
            expected[len(ids)] += len(ids)
        if len(versions) == 1:
            data = np.array(versions[0], "<u4").tobytes()
            at = 0
            for n, s, k, crc in sorted(got[doc_id]):
                assert (n, s) == (len(versions[0]), at) and k > 0 and crc == zlib.crc32(data[4 * s : 4 * (s + k)])
                at += k
            assert at == len(versions[0])
        assert sum(k for _, _, k, _ in got[doc_id]) == sum(map(len, versions))
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)  # no padding at all


def test_balance_spreads_cost():
    lengths = [700, 650, 600, 500, 400, 300, 300, 200, 150, 150, 100, 46] * 4
    sequences, left = packing.balance(lengths, 2048, 1.0, 1 / 2048)
    assert all(sum(n for *_, n in s) == 2048 for s in sequences) and sum(n for *_, n in left) == sum(lengths) % 2048
    costs = [sum(n + n * n / 2048 for *_, n in s) for s in sequences]
    assert max(costs) - min(costs) < 0.2 * max(costs)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    kinds = (
        (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), lambda m: len(m[2]) >= 6),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    return sorted((m.start(), kind, m.end()) for kind, (pattern, good) in enumerate(kinds) for m in pattern.finditer(text) if good(m))


def test_secrets(spark, docs, monkeypatch):
    reading(monkeypatch, docs)
    names = [k[0] for k in secrets.KINDS]
    rows = queries.op3_secrets(spark, "").collect()
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows)
    wanted = Counter()
    for r in docs.collect():
        spans = base_spans(r.text or "")
        n = Counter(k for _, k, _ in spans)
        joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        wanted[r.doc_id, n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert got == wanted
    for r in rows:
        base = [x for x in r.spans.split(",") if x.split(":")[0] in names[:3]]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_weak_parts_count_only_together(spark):
    far = " word" * 100
    rows = [(1, "user=alice and nothing else"), (2, "user=alice token=abcdef"), (3, "user=alice" + far + " token=abcdef"), (4, "https://host.example Zx9Qw8Er7Ty6Ui5Op4As"), (5, "Zx9Qw8Er7Ty6Ui5Op4As alone")]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.s for r in found.select("doc_id", secrets.span_text(F.col("spans")).alias("s")).collect()}
    assert got == {1: "", 2: "login:0:10,assign:11:23", 3: f"assign:{11 + len(far)}:{23 + len(far)}", 4: "endpoint:0:20,blob:21:41", 5: ""}


def test_quality(spark, docs, monkeypatch):
    reading(monkeypatch, docs)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in queries.op5_quality_rules(spark, "").collect())
    wanted = Counter()
    for r in docs.collect():
        text = r.text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeat = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = text.split("\n")
        dup = sum(bool(WORD.search(line)) and line in lines[:i] for i, line in enumerate(lines))
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        wanted[r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed] += 1
    assert got == wanted


def test_fertility_bands(spark):
    junk = "###$$$%%% " * 10 + " ".join(f"qzx{i:05d}kk%%%&&&" for i in range(80))
    model, ranks = queries._fertility()
    good = " ".join(f"reading{chr(97 + i % 26)} maps onward gently" for i in range(60))
    rows = spark.createDataFrame([(1, junk, "en"), (2, good, "xx")], "doc_id long, text string, lang string")
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.apply_rules(rows, model, max_repeat_percent=100).collect()}
    assert kept == {1: (False, False), 2: (False, True)}
    for second in (None, ranks):
        assert [r.doc_id for r in quality.filter_documents(rows, model, second, max_repeat_percent=100).collect()] == [2]


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(stopped.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return stopped | target
        stopped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, docs, monkeypatch):
    reading(monkeypatch, docs)
    rows = queries.op6_mixing(spark, "").collect()
    sizes, largest = Counter(), Counter()
    for r in docs.collect():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    targets, taken = brute_targets(sizes), Counter()
    source = {(r.doc_id, r.source): r for r in rows}
    assert len(rows) == docs.count() and source
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[r.source] += r.taken
    copies = Counter((r.doc_id, r.text) for r in docs.collect())
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] * max(copies.values())
    again = queries.op6_mixing(spark, "").collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in rows)


def brute_fingerprint(text: str, k: int = 3) -> int:
    words = WORD.findall(text.translate(UPPER))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[tuple]) -> list:
    least: dict[int, int] = {}
    seen: dict[int, int] = {}
    names = sorted({p for _, p in prints})
    parent = {p: p for p in names}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
        seen[p] = find(p)
    return [(d, p, least.get(seen[p])) for d, p in prints]


def test_simhash(spark, docs, monkeypatch):
    reading(monkeypatch, docs)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, "").collect())
    prints = [(r.doc_id, brute_fingerprint(r.text or "")) for r in docs.collect()]
    assert got == Counter((d, f"{p:016x}", c) for d, p, c in brute_components(prints))


def test_anchors_miss_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 150)
    prints = set(map(int, base))
    for p in list(prints):
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            q = (p & (1 << 64) - 1) ^ sum(1 << int(b) for b in flips)
            prints.add(q - (1 << 64) if q >> 63 else q)
    got = {(r.u, r.v) for r in simhash.near_links(spark.createDataFrame([(p,) for p in prints], "print long"), 2).collect()}
    wanted = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == wanted and len(wanted) > 100
    code = simhash.CoveringCode()
    words = np.arange(0, 1 << 23, 997, dtype=np.uint64)
    assert len(np.unique(code.nearest)) == 4096 and len(words) == len(code.home(words))


def brute_lines(rows: list, least: int = 10) -> list:
    key = lambda line: line.strip(SPACES).translate(UPPER)
    rank = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(r.doc_id)
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and r.doc_id != min(holders[key(x)], key=rank))]
        out.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark, docs, monkeypatch):
    reading(monkeypatch, docs)
    got = Counter(map(tuple, queries.op9_line_dedup(spark, "").select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
    wanted = Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(docs.collect()))
    assert got == wanted and sum(k for _, _, k, _ in wanted)


def test_line_index_is_reversible(spark, odd):
    references = linededup.line_references(odd, "doc_id", "text", 10)
    first, second = references.where("doc_id % 2 = 0"), references.where("coalesce(doc_id, 1) % 2 = 1")
    table = lambda index: set(map(tuple, index.counts.select("high", "low", "n", "first_id", "last_id").collect()))
    one = linededup.LineIndex.empty(spark, 4).insert(first)
    both = one.insert(second)
    back = both.delete(second.select("doc_id").distinct())
    assert table(back) == table(one) and table(both) != table(one)
    assert table(linededup.LineIndex.empty(spark, 4).insert(references)) == table(both)
    more = linededup.LineIndex.empty(spark, 4).insert(first).reshard(9).insert(second)
    assert table(more) == table(both) and table(more.delete(second.select("doc_id").distinct())) == table(one)
    known = {r.shard: linededup.CuckooFilter.load(r["filter"]) for r in back.filters.collect()}
    for r in one.counts.collect():
        assert known[r.shard].contains(np.array([r.high]), np.array([r.low])).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, (2, 20000))
    f = linededup.CuckooFilter(64)
    f.insert(keys[0, :10000], keys[1, :10000])
    f = linededup.CuckooFilter.load(f.dump())
    assert f.contains(keys[0, :10000], keys[1, :10000]).all() and f.contains(keys[0, 10000:], keys[1, 10000:]).mean() < 0.01
    f.delete(keys[0, :5000], keys[1, :5000])
    assert f.contains(keys[0, 5000:10000], keys[1, 5000:10000]).all() and f.contains(keys[0, :5000], keys[1, :5000]).mean() < 0.01


def brute_chunks(text: bytes, bits: int = 5, least: int = 16, most: int = 128) -> list[tuple[int, int]]:
    table, h, ends, last = chunks.gear_table().tolist(), 0, [], 0
    start = lambda i: i == len(text) or text[i] & 0xC0 != 0x80
    for i, byte in enumerate(text, 1):
        h = (2 * h + table[byte]) % (1 << 32)
        if i - last >= least and i - last <= most and h >> (32 - bits) == 0 and start(i) and len(text) - last > least:
            ends.append(i)
            last = i
        elif i - last == most and len(text) - last > most:
            while not start(i):
                i -= 1
            ends.append(i)
            last = i
    if last < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends))


def test_chunks(spark, docs):
    table = chunks.gear_table()
    for r in docs.collect():
        text = (r.text or "").encode()
        ends = chunks.boundaries(np.frombuffer(text, np.uint8), table, 5, 16, 128)
        got = list(zip([0, *ends[:-1]], ends))
        assert b"".join(text[a:b] for a, b in got) == text
        if text.isascii():
            assert got == brute_chunks(text)


def test_repeated_passages(spark, docs):
    held, where = defaultdict(set), defaultdict(list)
    rank = lambda d: 1 << 63 if d is None else d
    rows = docs.collect()
    for r in rows:
        text = (r.text or "").encode()
        ends = chunks.boundaries(np.frombuffer(text, np.uint8), chunks.gear_table(), 5, 16, 128)
        for a, b in zip([0, *ends[:-1]], ends):
            if b - a >= 16:
                held[text[a:b]].add(rank(r.doc_id))
                where[rank(r.doc_id), text].append((len(text[:a].decode()), len(text[:b].decode()), text[a:b]))
    wanted = set()
    for (d, _), own in where.items():
        spans = []
        for a, b, c in sorted(set(own)):
            if min(held[c]) < d:
                if not (spans and spans[-1][1] >= a):
                    spans.append([a, b, Counter()])
                spans[-1][1] = max(b, spans[-1][1])
                spans[-1][2][min(held[c])] += b - a
        for a, b, keepers in spans:
            if b - a >= 96:
                kept = [k for k, n in keepers.items() if n >= 96] or [min(keepers, key=lambda k: (-keepers[k], k))]
                wanted.add((d, a, b, tuple(sorted(kept))))
    got = {(rank(r.doc_id), r.start, r.end, tuple(sorted(map(rank, r.kept_doc_ids)))) for r in chunks.repeated_passages(docs).collect()}
    assert got == wanted


def test_passages_survive_shifts(spark, odd):
    got = {(r.doc_id, k) for r in chunks.repeated_passages(odd).collect() for k in r.kept_doc_ids}
    assert (13, 12) in got and (10, 9) in got and (11, 9) in got and not {d for d, _ in got} & {4, 5, 16, 18, 19}


def test_topk(spark, monkeypatch):
    from helixframe.llm import hamming

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 64))
    vectors[100:180] = vectors[100]
    vectors[300:330] = vectors[300] + rng.normal(scale=0.3, size=(30, 64))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(None, [1.0] * 64), (700, None), (50, [float(x) for x in vectors[50]])]
    codes = hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    all_codes = [(r.id, r.code & (1 << 64) - 1) for r in codes.collect()]
    assert len(all_codes) == 601
    got = defaultdict(list)
    for r in hamming.top_k(codes, codes.where("id % 100 = 0"), 10).collect():
        got[r.query_id].append((r["rank"], r.distance, r.id))
    for q, code in all_codes:
        if q % 100 == 0:
            best = sorted(((code ^ c).bit_count(), i) for i, c in all_codes)[:10]
            assert sorted(got[q]) == [(n, d, i) for n, (d, i) in enumerate(best, 1)]
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0
    # Columns of the input named like those of the search change nothing.
    clash = [(1, [1.0] * 64, 5, "x", 3, 2), (2, [-1.0] * 64, 5, "x", 3, 2), (3, [1.0] * 63 + [-1.0], None, "y", 1, 0)]
    named = hamming.sign_codes(spark.createDataFrame(clash, "vec_id long, embedding array<double>, id long, code string, q long, distance long"), "vec_id", "embedding")
    assert [(r.id, r.distance) for r in hamming.top_k(named, named.where("id = 1"), 3).orderBy("rank").collect()] == [(1, 0), (3, 1), (2, 64)]
    assert hamming.top_k(codes.where("id < 3"), codes.where("id = 0")).count() == 3


def test_wide_and_short_vectors(spark):
    from helixframe.llm import hamming

    rows = [(1, [1.0] * 64 + [-2.0] * 64), (2, [1.0] * 64 + [2.0] + [-2.0] * 5), (3, [1.0, -1.0, None]), (4, [])]
    got = {r.id: r.code & (1 << 64) - 1 for r in hamming.sign_codes(spark.createDataFrame(rows, "v long, e array<float>"), "v", "e").collect()}
    assert got == {1: 0, 2: ((1 << 64) - 1) & ~0b111110, 3: 1, 4: 0}


def test_token_counts(spark, docs):
    from helixframe.llm import attribution

    t = tokenizer()
    for rule in ("majority", "start"):
        got = Counter()
        for r in attribution.count_tokens(docs, *vocabulary(), fields=("source", "text"), sectioned="text", rule=rule).collect():
            got[r.doc_id, r.field, r.section, r.start, r.end, r.n_tokens] += 1
        wanted = Counter()
        for r in docs.collect():
            parts = [("source", 0, r.source or "", " ")] + [("text", i, x, "\n") for i, x in enumerate((r.text or "").split("\n"))]
            whole = (r.source or "") + " " + (r.text or "")
            owner = b"".join(bytes([i % 251]) * len((x + s).encode()) for i, (_, _, x, s) in enumerate(parts))
            index = [i for i, (_, _, x, s) in enumerate(parts) for _ in range(len((x + s).encode()))]
            assert len(owner) == len(index)
            counts, at = Counter(), 0
            vocabulary_bytes = _bytes_of(t)
            for token in t.encode(whole, add_special_tokens=False).ids:
                own = index[at : at + vocabulary_bytes[token]]
                at += vocabulary_bytes[token]
                counts[own[0] if rule == "start" else max(sorted(set(own)), key=own.count)] += 1
            point = 0
            for i, (f, n, x, _) in enumerate(parts):
                wanted[r.doc_id, f, n, point, point + len(x), counts[i]] += 1
                point += len(x) + 1
        assert got == wanted


def _bytes_of(t) -> list[int]:
    global _LENGTHS
    if "_LENGTHS" not in globals():
        names = t.get_vocab()
        _LENGTHS = [0] * (max(names.values()) + 1)
        for name, i in names.items():
            _LENGTHS[i] = len(name)  # byte-level: one character stands for one byte
    return _LENGTHS


def brute_shards(rows: list[tuple[int, int]], limit: int, bits: int) -> dict[int, str]:
    """Row number -> prefix, splitting only what is too large."""
    out, todo = {}, [("", list(range(len(rows))))]
    while todo:
        prefix, inside = todo.pop()
        if sum(rows[i][1] for i in inside) <= limit or len(inside) == 1 or len(prefix) == bits:
            out |= dict.fromkeys(inside, prefix)
            continue
        for bit in "01":
            part = [i for i in inside if f"{rows[i][0]:0{bits}b}"[len(prefix)] == bit]
            if part:
                todo.append((prefix + bit, part))
    return out


def test_sharding(spark, documents, odd):
    from helixframe.llm import sharding

    rows = [(r.doc_id, len((r.text or "").encode()), int(hashlib.md5(f"{r.doc_id}:{r.text or ''}".encode()).hexdigest()[:10], 16)) for r in documents.collect()]
    for limit in (1 << 40, 40_000, 3_000, 1):
        wanted = brute_shards([(k, n) for _, n, k in rows], limit, 40)
        got = {r.doc_id: r for r in sharding.shard(documents, limit).collect()}
        assert len(got) == len(rows) and all(got[d].shard == wanted[i] for i, (d, _, _) in enumerate(rows))
        total, count = Counter(), Counter()
        for i, (_, n, _) in enumerate(rows):
            total[wanted[i]] += n
            count[wanted[i]] += 1
        assert all((r.shard_bytes, r.shard_rows, r.depth) == (total[r.shard], count[r.shard], len(r.shard)) for r in got.values())
    same = documents.limit(1).select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("copy"))
    size = same.first().text
    parts = Counter(r.shard for r in sharding.shard(same, 10 * len(size.encode())).collect())
    assert sum(parts.values()) == 50 and max(parts.values()) <= 10  # equal rows part as well
    assert sharding.shard(odd, 1000).count() == odd.count()


def test_equal_rows_part_to_the_last(spark):
    from helixframe.llm import sharding

    rows = sharding.shard(spark.range(300).selectExpr("7L AS doc_id", "'abc' AS text", "'x' AS bytes", "1 AS key"), 3).collect()
    assert len({r.shard for r in rows}) == 300 and all(r.shard_rows == 1 and r.depth > 40 for r in rows)


def test_empty_tables(spark, nothing, monkeypatch):
    import corpus_pipeline as p

    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    monkeypatch.setattr(queries, "_table", lambda _s, _d, name: vectors if name == "embeddings" else nothing)
    for name, query in queries.queries().items():
        if name != "pipeline":
            assert query(spark, "").count() == 0, name
    for name, stage in p.STAGES:
        assert stage(spark, nothing, "").count() == 0, name


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    docs = docs.select(p.COLUMNS)
    stages = dict(p.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    kept = stages["quality rules"](spark, docs, "")
    verdicts = quality.apply_rules(docs, *queries._fertility()).where("kept")
    assert kept.columns == p.COLUMNS and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in verdicts.collect())

    lines = stages["line dedup"](spark, docs, "")
    wanted = Counter((d, t or "") for d, _, k, t in brute_lines(docs.collect()) if not k or t.strip(SPACES))
    assert lines.columns == p.COLUMNS and Counter((r.doc_id, r.text or "") for r in lines.collect()) == wanted
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text is not None)

    mixed = stages["mixing"](spark, docs, "")
    wanted = Counter()
    texts = {(r.doc_id, r.source, len(WORD.findall(r.text or "")), r.text) for r in docs.collect()}
    taken = Counter()
    for r in mixing.mix(docs, keep=("text",)).where("size > 0").collect():
        assert (r.doc_id, r.source, r.size, r.text) in texts
        taken[r.doc_id, r.source, r.text] += r.copies
    got = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    assert mixed.columns == p.COLUMNS and got == +taken
    check_pieces(stages["packing"](spark, mixed, "").withColumn("ids_crc32", F.crc32("ids")).collect(), mixed.collect())


def test_blank_rests_go(spark):
    import corpus_pipeline as p

    rows = [(1, "a line that repeats", "en", "s", 0), (2, "a line that repeats\n\t\n", "en", "s", 0), (3, "\n\t", "en", "s", 0), (4, None, "en", "s", 0)]
    got = dict(p.STAGES)["line dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == [(1, 19), (3, 2), (4, None)]


def test_pipeline_runs(spark):
    rows = queries.pipeline(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.length > 0 for r in rows)

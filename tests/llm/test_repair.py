"""Conversation repair against all edits of small conversations, and against a plain dynamic program."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import queries, repair

SPACES = " \t\n\v\f\r"
ROWS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        yield conv, [] if kind == 0 else [row] * (2 if kind == 3 else 1)


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        words = text.strip(SPACES)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest(turns, found, most_inserts):
    """All edit sequences, by brute force."""
    best = None

    def go(i, cost, audit, out, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(turns) and legal("".join(r[:1] or "-" for r, _ in out)):
            best = min(best, (cost, audit, list(out)), key=lambda x: x[:2]) if best else (cost, audit, list(out))
        for role in ("user", "assistant") if inserts else ():
            go(i, cost + 5, audit + "I", [*out, (role, "")], inserts - 1)
        if i < len(turns):
            go(i + 1, cost + 2, audit + "D", out, inserts)
            if found[i] not in ("blank", "duplicate"):
                more = 5 * (found[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*out, turns[i]], inserts)
                for role in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", [*out, (role, turns[i][1])], inserts)

    go(0, 0, "", [], most_inserts)
    return best


def plain(turns, found):
    """The same by a table of prefixes and states."""
    machine = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = {"": (0, "", ())}

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", (*out, (role, "")))
                if role[0] not in table or new[:2] < table[role[0]][:2]:
                    table[role[0]] = new
        return table

    for (role, text), fault in zip(turns, found):
        new = {}

        def offer(state, value):
            if state not in new or value[:2] < new[state][:2]:
                new[state] = value

        for state, (cost, audit, out) in inserted(table).items():
            offer(state, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (state, role[:1]) in machine:
                    offer(machine[state, role[:1]], (cost + more, audit + "K", (*out, (role, text))))
                other = "assistant" if state == "u" else "user"
                offer(other[0], (cost + more + 1, audit + "R", (*out, (other, text))))
        table = new
    return min((v for s, v in inserted(table).items() if s in ("", "a")), key=lambda v: v[:2])


def expected(rows, solve):
    convs = defaultdict(list)
    for conv, kept in damaged(rows):
        convs[conv] += kept
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[2:] for r in kept]
        found = faults(turns)
        cost, audit, final = solve(turns, found)
        numbers = {r[1] for r in kept} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def got(df):
    rows = df.collect()
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in columns) for r in rows}


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " ", None, "end. \n", "é漢.", "…", "a\nb."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "student"]
    rows = []
    for conv in range(conversations):
        for _ in range(rng.randint(1, most)):
            rows.append((conv if conv else None, rng.choice([None, *range(2 * most)]), rng.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."))
    return rows + rows[:: 3 * most]


def test_plain_against_all_edits():
    rng = random.Random(5)
    for n in range(150):
        turns = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!", " "])) for _ in range(n % 5)]
        found = faults(turns)
        assert plain(turns, found)[:2] == cheapest(turns, found, 2)[:2] and list(plain(turns, found)[2]) == cheapest(turns, found, 2)[2]


@pytest.mark.parametrize("size", [128, 2])
def test_query(spark, monkeypatch, size):
    rows = random_rows(1, 120, 9) + [(777, t, ["user", "assistant"][t % 2], f"turn {t // 3}" + "." * (t % 4 > 0)) for t in range(900)] + [(778, 3, "user", "Same.")] * 400
    df = spark.createDataFrame(rows, ROWS).withColumns({"piece": F.lit(1), "n": F.lit(2), "first": F.lit("x"), "copies": F.lit(9), "task": F.lit(0)}).repartition(3)
    monkeypatch.setattr(queries, "_table", lambda *_: df)
    if size != 128:
        whole = repair.repair
        monkeypatch.setattr(repair, "repair", lambda *a, **k: whole(*a, **k, segment_rows=size, fan_in=3))
    found, wanted = got(queries.op11_structure_repair(spark, "")), expected(rows, plain)
    assert found == wanted


def test_tables(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    monkeypatch.setattr(queries, "_table", lambda *_: df)
    found, wanted = got(queries.op11_structure_repair(spark, "")), expected(map(tuple, df.collect()), plain)
    assert found == wanted
    monkeypatch.setattr(queries, "_table", lambda *_: df.limit(0))
    assert queries.op11_structure_repair(spark, "").count() == 0
    dropped = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    monkeypatch.setattr(queries, "_table", lambda *_: spark.createDataFrame([(dropped, 0, "user", "x")], ROWS))
    assert got(queries.op11_structure_repair(spark, "")) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_pieces_are_well_formed(spark):
    rows = [(5, t, "user", f"{t}.") for t in range(300)] + [(6, 1, "assistant", "x" * 2_000_000 + ".")]
    pieces = sorted(repair.repair(spark.createDataFrame(rows, ROWS), segment_rows=50).collect(), key=lambda r: (r.conv_id, r.piece))
    turns = [t for r in pieces if r.conv_id == 5 for t in r.turns]
    assert legal("".join(t.role[0] for t in turns)) and len(turns) == 300
    assert sum(len(r.turns) for r in pieces if r.conv_id == 6) == 0 and [r.cost for r in pieces if r.piece == 0] == [150, 2]

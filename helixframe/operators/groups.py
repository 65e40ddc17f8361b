"""Components of a program over bits, solved one by one inside tasks: Spark deals components to tasks, and numpy adds up their tables."""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize_count

#: Cells that a table may have while a variable goes.
CELLS = 1 << 20
#: Of a component that needs larger ones, variables are tried with each of their values: cells of a table then, and trials at most.  One that needs more is left to rounds of joins.
TRIED_CELLS, TRIALS = 1 << 17, 1 << 12
_NO = -np.inf
#: By (ab, bc, ac), 0 from the first to the second: not all three of a triangle around.
_CIRCLE = np.zeros((2, 2, 2))
_CIRCLE[0, 0, 1] = _CIRCLE[1, 1, 0] = _NO


def maximise(factors: list[tuple[tuple[int, ...], np.ndarray]], cells: int = CELLS, trials: int = 0) -> dict[int, int] | None:
    """The values of all variables with the greatest sum of ``factors`` (ascending variables, table); None if that takes more than so many ``trials`` or nothing is allowed.

    Whatever variable has the smallest table over its neighbours goes first: its
    tables are added up and leave one with the best that it can do.  Where even
    that table is larger than ``cells``, the variable with the most neighbours is
    tried with each of its values, but for those whose tables, each at its
    greatest, add up to no more than what is found already; the values are exact
    either way.
    """
    left = [trials]
    best = _maximise(factors, cells, left, _NO)
    return None if best is None or left[0] < 0 else best[1]


def _maximise(factors, cells: int, left: list[int], least: float) -> tuple[float, dict[int, int]] | None:
    """The greatest sum and its values, None if none is above ``least``; ``left`` has the trials that are left, below 0 if there were too few."""
    size, of, live = {}, defaultdict(set), dict(enumerate(factors))
    for i, (scope, table) in live.items():
        for v, n in zip(scope, table.shape):
            size[v] = n
            of[v].add(i)
    around = lambda v: {w for i in of[v] for w in live[i][0]}
    cost = {v: prod(size[w] for w in around(v)) for v in size}
    queue = [(c, v) for v, c in cost.items()]
    heapify(queue)
    undo, summed, value = [], 0.0, {}
    while queue:
        c, v = heappop(queue)
        if cost.get(v) != c:
            continue
        if c > cells:
            found = _tried(list(live.values()), max(cost, key=cost.get), cells, left, least - summed)
            if found is None:
                return None
            summed, value = summed + found[0], found[1]
            break
        scope = sorted(around(v))
        total = 0.0
        for i in list(of[v]):
            own, table = live.pop(i)
            total = total + table.reshape([size[w] if w in own else 1 for w in scope])
            for w in own:
                of[w].discard(i)
        at = scope.index(v)
        rest = (*scope[:at], *scope[at + 1 :])
        best = total.max(axis=at)
        undo.append((v, rest, total.argmax(axis=at).astype(np.int8)))
        del cost[v]
        if not rest:
            if best == _NO:
                return None
            summed += float(best)
            continue
        i = len(factors) + len(undo)
        live[i] = rest, best
        for w in rest:
            of[w].add(i)
        for w in rest:
            cost[w] = prod(size[x] for x in around(w))
            heappush(queue, (cost[w], w))
    if summed <= least:
        return None
    for v, rest, choice in reversed(undo):
        value[v] = int(choice[tuple(value[w] for w in rest)])
    return summed, value


def _tried(factors, v: int, cells: int, left: list[int], least: float) -> tuple[float, dict[int, int]] | None:
    """As :func:`_maximise`, with each value of ``v`` set in turn, the one that promises most first."""
    ways = []
    for x in range(next(table.shape[scope.index(v)] for scope, table in factors if v in scope)):
        told = [((*scope[: (at := scope.index(v))], *scope[at + 1 :]), table.take(x, axis=at)) if v in scope else (scope, table) for scope, table in factors]
        ways.append((sum(float(table.max()) for _, table in told), x, told))
    best = None
    for most, x, told in sorted(ways, key=lambda w: -w[0]):
        if most <= least:
            continue
        left[0] -= 1
        if left[0] < 0:
            return None
        alone = sum(float(table) for scope, table in told if not scope)
        found = _maximise([f for f in told if f[0]], cells, left, least - alone)
        if left[0] < 0:
            return None
        if found is not None:
            least = found[0] + alone
            best = least, found[1] | {v: x}
    return best


def _numbered(u: np.ndarray, v: np.ndarray) -> tuple[int, list[tuple[int, int]], dict[tuple[int, int], int], list[tuple[int, int, int]]]:
    """Number of nodes, edges between their places, the place of each edge, and the triangles by the places of ab, bc, ac."""
    place = {x: i for i, x in enumerate(sorted({*u, *v}))}
    edges = [(place[a], place[b]) for a, b in zip(u, v)]
    at = {e: k for k, e in enumerate(edges)}
    up = defaultdict(set)
    for a, b in edges:
        up[a].add(b)
    return len(place), edges, at, [(at[a, b], at[b, c], at[a, c]) for a, b in edges for c in up[a] & up[b]]


def _best(w: tuple, equal: bool) -> int:
    return (0 if w[0] >= w[3] else 3) if equal else (1 if w[1] >= w[2] else 2)


def _told(table: np.ndarray, axis: int, value) -> np.ndarray:
    """``table`` with all forbidden but one value along an axis."""
    out = np.full_like(table, _NO)
    keep = (slice(None),) * axis + (value,)
    out[keep] = table[keep]
    return out


def orientations(u: np.ndarray, v: np.ndarray, weights: np.ndarray, told: np.ndarray) -> list[tuple[int, int, int]] | None:
    """(orien_a, orien_b, state) of each edge of a component; ``told`` has the given orientations and direction of each, -1 for none."""
    n, edges, _, tris = _numbered(u, v)
    bound = {k for t in tris for k in t} | {k for k, t in enumerate(told) if t[2] >= 0}
    if len(edges) == 1 and not bound and told.max() < 0:
        state = int(np.argmax(weights[0]))
        return [(0, int(state in (1, 2)), state)]
    factors = []
    for k, ((a, b), w, (ta, tb, td)) in enumerate(zip(edges, weights.tolist(), told.tolist())):
        if k in bound:
            scope, table = (a, b, n + k), np.array([[[w[2 * x + y], w[3 - 2 * x - y]] for y in (0, 1)] for x in (0, 1)])
        else:
            same, other = max(w[0], w[3]), max(w[1], w[2])
            scope, table = (a, b), np.array([[same, other], [other, same]])
        for axis, t in enumerate((ta, tb, td)):
            table = table if t < 0 else _told(table, axis, t)
        factors.append((scope, table))
    for t in tris:
        ab, bc, ac = (n + k for k in t)
        order = sorted((ab, bc, ac))
        factors.append((tuple(order), _CIRCLE.transpose([(ab, bc, ac).index(x) for x in order])))
    if told.max() < 0:
        # All contigs turned around, with all directions, weigh the same.
        ends = [x for e in edges for x in e]
        factors.append(((max(set(ends), key=ends.count),), np.array([0.0, _NO])))
    value = maximise(factors) or maximise(factors, TRIED_CELLS, TRIALS)
    if value is None:
        return None
    out = []
    for k, ((a, b), w) in enumerate(zip(edges, weights.tolist())):
        x, y = value[a], value[b]
        ahead = 2 * x + y
        out.append((x, y, _best(w, x == y) if k not in bound else 3 - ahead if value[n + k] else ahead))
    return out


def paths(u: np.ndarray, v: np.ndarray, weights: np.ndarray, told: np.ndarray) -> list[tuple[int, int, int]] | None:
    """(orien_a, orien_b, state) of each edge of a component of the path model; state -1 is unused.

    An edge is unused, leads ahead or back; what ends of a contig its edges have
    taken so far goes from one to the next.
    """
    n, edges, _, tris = _numbered(u, v)
    factors, at = [], defaultdict(list)
    for k, ((a, b), w) in enumerate(zip(edges, weights.tolist())):
        factors.append(((a, b, n + k), np.array([[[0.0, w[2 * x + y], w[3 - 2 * x - y]] for y in (0, 1)] for x in (0, 1)])))
        # The way in is bit 1, the way out bit 2.
        at[a].append((n + k, (0, 2, 1)))
        at[b].append((n + k, (0, 1, 2)))
    free = n + len(edges)
    for own in at.values():
        if len(own) < 2:
            continue
        before, takes = own[0]
        for e, more in own[1:-1]:
            table = np.full((len(takes), 3, 4), _NO)
            for i, x in enumerate(takes):
                for j, y in enumerate(more):
                    if not x & y:
                        table[i, j, x | y] = 0.0
            order = sorted((before, e))
            factors.append(((*order, free), table if before < e else table.transpose(1, 0, 2)))
            before, takes, free = free, (0, 1, 2, 3), free + 1
        e, more = own[-1]
        table = np.array([[_NO if x & y else 0.0 for y in more] for x in takes])
        factors.append(((before, e), table) if before < e else ((e, before), table.T))
    for t in tris:
        table = np.zeros((3, 3, 3))
        table[1, 1, 2] = table[2, 2, 1] = _NO
        three = tuple(n + k for k in t)
        order = sorted(three)
        factors.append((tuple(order), table.transpose([three.index(x) for x in order])))
    value = maximise(factors)
    if value is None:
        return None
    out = []
    for k, (a, b) in enumerate(edges):
        x, y, way = value[a], value[b], value[n + k]
        out.append((x, y, -1 if not way else 2 * x + y if way == 1 else 3 - 2 * x - y))
    return out


_GIVEN = ["told_a", "told_b", "told_way"]


def _whole(batches, most: int):
    """Sorted rows of components (root, m, ...) with none cut in two, but for those of more than ``most`` rows."""
    kept = None  # the last component of a batch may go on in the next one; of a larger one, no more than a batch is held
    for batch in batches:
        kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        root = kept["root"].to_numpy()
        last = np.flatnonzero(root[1:] != root[:-1])
        if not len(last):
            if not len(kept) or kept["m"].iloc[0] <= most:
                continue
            done, kept = kept, None
        else:
            done, kept = kept.iloc[: last[-1] + 1], kept.iloc[last[-1] + 1 :].reset_index(drop=True)
        yield done
    if kept is not None and len(kept):
        yield kept


def label_edges(edges: DataFrame, roots: DataFrame, end: str, solver, kind: str, most: int, label: str) -> tuple[DataFrame, int]:
    """``edges`` with ``root``, the number ``m`` of edges in the component (``roots``: node, root; ``end`` is the column of a node) and a ``label`` of type ``kind``; and how many have none.

    ``solver`` takes the edges of one component as a list of rows in ascending
    order and gives a label for each.  In components of more than ``most``
    edges labels are null.
    """
    columns = edges.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema), f"root {roots.schema['root'].dataType.simpleString()}", "m bigint", f"label {kind}"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        root, m = rows["root"].to_numpy(), rows["m"].to_numpy()
        cuts = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(rows)]
        values = list(zip(*(rows[c].tolist() for c in columns)))
        found = []
        for a, b in zip(cuts, cuts[1:]):
            found += solver(values[a:b]) if m[a] <= most else [None] * (b - a)
        return rows.assign(label=pd.Series(found, dtype=object, index=rows.index))

    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism
    order = Window.partitionBy("root").orderBy(*columns)
    named = edges.join(roots.select(F.col("node").alias(end), "root"), end).select(*columns, "root").repartition(tasks, "root")
    sized = named.withColumn("m", F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    run = lambda batches: map(answer, _whole(batches, most))
    return materialize_count(sized.mapInPandas(run, schema), label, F.count_if(F.col("m") > most))


def block_labels(edges: list[tuple]) -> list:
    """Of a connected graph of edges (u, v): the biconnected component of each, by the smallest node in it besides its top in a search from the smallest node."""
    around = defaultdict(list)
    for i, (u, v) in enumerate(edges):
        around[u].append((v, i))
        around[v].append((u, i))
    labels: list = [None] * len(edges)
    start = min(around)
    number, low, seen, open_ = {start: 0}, {start: 0}, set(), []
    way = [(start, iter(around[start]), -1)]
    while way:
        at, more, by = way[-1]
        for to, i in more:
            if i in seen:
                continue
            seen.add(i)
            open_.append(i)
            if to not in number:
                number[to] = low[to] = len(number)
                way.append((to, iter(around[to]), i))
                break
            low[at] = min(low[at], number[to])
        else:
            way.pop()
            if not way:
                break
            top = way[-1][0]
            low[top] = min(low[top], low[at])
            if low[at] >= number[top]:
                first = open_.index(by)
                block, open_ = open_[first:], open_[:first]
                name = min(x for i in block for x in edges[i] if x != top)
                for i in block:
                    labels[i] = name
    return labels


class Reach:
    """Which nodes lead to which, as sets of bits, while edges are added."""

    def __init__(self, edges: list[tuple]):
        self.nodes = sorted({x for e in edges for x in e[:2]})
        self.place = {x: i for i, x in enumerate(self.nodes)}
        self.after = [0] * len(self.nodes)

    def add(self, src, dst) -> None:
        a, b = self.place[src], self.place[dst]
        new = self.after[b] | 1 << b
        if new & ~self.after[a]:
            for i, after in enumerate(self.after):
                if i == a or after >> a & 1:
                    self.after[i] = after | new

    def leads(self, src, dst) -> bool:
        return bool(self.after[self.place[src]] >> self.place[dst] & 1)


def strong_labels(edges: list[tuple]) -> list:
    """Of edges (src, dst): the greatest node of the strongly connected component that both ends are in, None if they are in none."""
    reach = Reach(edges)
    for e in edges:
        reach.add(*e[:2])
    # What lies on one cycle leads to the same nodes, itself among them.
    greatest = {after: x for i, (x, after) in enumerate(zip(reach.nodes, reach.after)) if after >> i & 1}
    return [greatest[reach.after[reach.place[b]]] if reach.leads(b, a) else None for a, b, *_ in edges]


def lightest_labels(edges: list[tuple]) -> list:
    """Of edges (src, dst, weight): 1 for the lightest of some cycle, of equals the smallest (src, dst), else 0."""
    reach = Reach(edges)
    goes = [0] * len(edges)
    for i in sorted(range(len(edges)), key=lambda i: (edges[i][2], *edges[i][:2]), reverse=True):
        src, dst = edges[i][:2]
        goes[i] = int(reach.leads(dst, src))
        reach.add(src, dst)
    return goes


def order_labels(edges: list[tuple]) -> list[dict]:
    """Of a rooted tree of edges (src, dst), parent to child: its root and the ranks of dst in preorder and postorder; children in ascending order."""
    below = defaultdict(list)
    for a, b in edges:
        below[a].append(b)
    root = (set(below) - {b for _, b in edges}).pop()
    pre, post, way = {root: 0}, {}, [(root, iter(sorted(below[root])))]
    while way:
        at, more = way[-1]
        child = next(more, None)
        if child is None:
            post[at] = len(post)
            way.pop()
        else:
            pre[child] = len(pre)
            way.append((child, iter(sorted(below.get(child, ())))))
    return [{"root": root, "pre": pre[b], "post": post[b]} for _, b in edges]


def solve_components(edges: DataFrame, roots: DataFrame, solver, max_bundles: int, label: str) -> tuple[DataFrame, int]:
    """``edges`` (u, v, w0..w3, told_a, told_b, told_way) with orien_a, orien_b and state as ``solver`` finds them, one component (``roots``: node, root) at a time; and how many have none.

    ``orien_a`` is null in components of more than ``max_bundles`` edges or too
    wide for what ``solver`` tries.
    """
    named = edges.join(roots.select(F.col("node").alias("u"), "root"), "u")
    sizes = named.groupBy("root").agg(F.count("*").alias("m"))
    kind = edges.schema["u"].dataType.simpleString()
    schema = f"u {kind}, v {kind}, w0 double, w1 double, w2 double, w3 double, told_a int, told_b int, told_way int, orien_a int, orien_b int, state int"
    columns = [c.split()[0] for c in schema.split(", ")]
    sized = named.join(sizes, "root").select("root", "m", *columns[:-3])

    def run(batches):
        return map(answer, _whole(batches, max_bundles))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        root, m, u, v = (rows[c].to_numpy() for c in ("root", "m", "u", "v"))
        weights, given = rows[["w0", "w1", "w2", "w3"]].to_numpy(float), rows[_GIVEN].fillna(-1).to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(rows)]
        found = []
        for a, b in zip(cuts, cuts[1:]):
            own = solver(u[a:b], v[a:b], weights[a:b], given[a:b]) if m[a] <= max_bundles else None
            found += own or [(None, None, None)] * (b - a)
        out = rows[columns[:-3]].reset_index(drop=True)
        for c, values in zip(columns[-3:], zip(*found)):
            out[c] = pd.array(values, dtype="Int32")
        return out

    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism
    dealt = sized.repartition(tasks, "root").sortWithinPartitions("root", "u", "v")
    return materialize_count(dealt.mapInPandas(run, schema), label, F.count_if(F.col("orien_a").isNull()))

"""Orientation and direction of contigs and bundles: the integer program, as joins over its pieces.

A solution gives every contig an orientation and every bundle one of its four
states, which with the orientations says the bundle's direction; no three
bundles may run in a circle.  The weights of the chosen states are to be
greatest.  As a sum of small tables it is maximised by
:mod:`.elimination`, in all components at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import links as X
from ..tables import materialize
from . import elimination as E
from . import graph as G
from . import groups as C
from .links import triangles, with_pair
from .paths import with_rank


def canonical_bundles(bundles: DataFrame) -> DataFrame:
    """(u, v, w0..w3) with u < v, one row per pair; of a swapped pair, states B and C are as they are and A, D as well (weights are per state of the pair)."""
    summed = with_pair(bundles).where("lo <> hi").groupBy(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return summed.agg(*(F.sum(f"WT_{c}").alias(f"w{i}") for i, c in enumerate("ABCD")))


def _best_state(equal: F.Column, prefer: str = "w") -> F.Column:
    """The heavier state of those that fit equal or unequal orientations; of equal weights the first."""
    w = [F.col(f"{prefer}{i}") for i in range(4)]
    return F.when(equal, F.when(w[0] >= w[3], 0).otherwise(3)).otherwise(F.when(w[1] >= w[2], 1).otherwise(2))


def _weight(state: F.Column) -> F.Column:
    return F.element_at(F.array("w0", "w1", "w2", "w3"), state.cast("int") + 1)


def triangle_edges(tris: DataFrame) -> DataFrame:
    """(u, v): bundles that are sides of triangles."""
    return tris.select(F.inline(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("ab", "bc", "ac"))))).distinct()


def _orientation(node: str) -> F.Column:
    """The variable of a contig's orientation."""
    return F.concat(F.lit("o:"), F.col(node).cast("string"))


def _direction(u: str, v: str) -> F.Column:
    """The variable of a bundle's direction: 0 is u to v."""
    return F.concat(F.lit("d:"), F.col(u).cast("string"), F.lit("-"), F.col(v).cast("string"))


def _explode_bits(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.explode(F.array(F.lit(0), F.lit(1))))
    return df


def _pair(var: F.Column, bit: F.Column | str) -> F.Column:
    return F.struct(var.alias("var"), (F.col(bit) if isinstance(bit, str) else bit).cast("int").alias("bit"))


def _free(edges: DataFrame, directed: DataFrame) -> DataFrame:
    """Edges with ``free``: whether nothing but the orientations decides the direction; the others are in ``directed`` (u, v)."""
    marked = directed.select("u", "v").distinct().withColumn("free", F.lit(False))
    return edges.join(marked, ["u", "v"], "left").withColumn("free", F.coalesce("free", F.lit(True)))


def tables(edges: DataFrame, tris: DataFrame) -> DataFrame:
    """The program over ``edges`` (u, v, w0..w3, free) as factors, see :mod:`.elimination`.

    A free bundle is worth the heavier state that fits the orientations of its
    ends; another one has a variable for its direction, and of the three in a
    triangle not all may run around.
    """
    su, sv = _pair(_orientation("u"), "su"), _pair(_orientation("v"), "sv")
    both = _explode_bits(edges, "su", "sv")
    name = F.concat(F.lit("e:"), F.col("u").cast("string"), F.lit("-"), F.col("v").cast("string"))
    free = both.where("free").select(*E.factor(name, F.array(su, sv), _weight(_best_state(F.col("su") == F.col("sv")))))
    ahead = 2 * F.col("su") + F.col("sv")
    told = _explode_bits(both.where("not free"), "d")
    told = told.select(*E.factor(name, F.array(su, sv, _pair(_direction("u", "v"), "d")), _weight(F.when(F.col("d") == 0, ahead).otherwise(3 - ahead))))
    circles = _explode_bits(tris.select("a", "b", "c"), "ab", "bc", "ac").where("ab <> bc or ab = ac")
    sides = F.array(*(_pair(_direction(x, y), x + y) for x, y in ("ab", "bc", "ac")))
    return free.unionByName(told).unionByName(circles.select(*E.factor(F.concat_ws("-", F.lit("t:"), "a", "b", "c"), sides, F.lit(0.0))))


def orient(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, root, orien): orientations under which the edges of ``tree`` (see :func:`.graph.rooted_forest`) have their heavier parity; the smallest node has 0."""
    parity = edges.select("u", "v", (F.greatest("w1", "w2") > F.greatest("w0", "w3")).cast("int").alias("odd"))
    up = tree.where("parent is not null").select("node", "parent", "root", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    steps = up.join(parity, ["u", "v"]).select("node", "parent", "root", "odd")
    roots = tree.where("parent is null").select("node", "parent", "root", F.lit(0).alias("odd"))
    at = materialize(steps.union(roots), "solve-parity")
    # Pointer doubling to the root: each round adds the parity of the node that the pointer reaches.
    while not at.where("parent is not null").isEmpty():
        far = at.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("odd").alias("more"))
        at = at.join(far, "parent", "left").select("node", F.col("next").alias("parent"), "root", (F.coalesce("more", F.lit(0))).bitwiseXOR(F.col("odd")).alias("odd"))
        at = materialize(at, "solve-parity")
    return at.select("node", "root", F.col("odd").alias("orien"))


def improve(edges: DataFrame, start: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(node, orien): orientations ``start`` (node, orien) after turning contigs for the sake of bundles (u, v, w0..w3).

    A contig turns if that adds weight and no neighbour gains more by its own
    turn (of equals, by a hash), so every round adds weight; it ends when nothing
    gains.  Contigs in ``pinned`` (node) never turn.
    """
    at = materialize(start.select("node", "orien"), "solve-turned")
    gain = F.greatest("w1", "w2") - F.greatest("w0", "w3")
    while True:
        name = lambda x: at.select(F.col("node").alias(x), F.col("orien").alias(f"s{x}"))  # noqa: B023, E731
        step = edges.join(name("u"), "u").join(name("v"), "v").select("u", "v", F.when(F.col("su") == F.col("sv"), gain).otherwise(-gain).alias("gain"))
        per = step.select(F.explode(F.array("u", "v")).alias("node"), "gain").groupBy("node").agg(F.sum("gain").alias("gain")).where("gain > 0")
        per = materialize(per if pinned is None else per.join(pinned.select("node"), "node", "left_anti"), "solve-gains")
        if per.isEmpty():
            return at
        rank = lambda x: per.select(F.col("node").alias(x), F.struct("gain", F.xxhash64("node"), "node").alias(f"g{x}"))  # noqa: B023, E731
        beaten = step.select("u", "v").join(rank("u"), "u").join(rank("v"), "v").select(F.when(F.col("gu") < F.col("gv"), F.col("u")).otherwise(F.col("v")).alias("node"))
        turn = per.join(beaten, "node", "left_anti").select("node", F.lit(1).alias("turn"))
        at = materialize(at.join(turn, "node", "left").select("node", F.col("orien").bitwiseXOR(F.coalesce("turn", F.lit(0))).alias("orien")), "solve-turned")


def break_circles(full: DataFrame, tris: DataFrame) -> DataFrame:
    """Solved bundles (u, v, w0..w3, state, orien_a, orien_b, status, kept) without circles of three among the heuristic ones.

    First, of each circle, the bundle that loses least by it turns, once each,
    but for those that are ``kept``.
    What circles are left lie in clusters of triangles that share bundles; each
    such cluster takes its directions from one order of its contigs, the best of
    three, and an order has no circles.
    """
    full = materialize(full.withColumn("turned", F.col("kept")), "solve-full")
    tris = materialize(tris.join(full.where("status = 'heuristic'").select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_semi").select("a", "b", "c"), "solve-open-triangles")
    way = lambda: full.select("u", "v", "turned", X.direction("state", "orien_a", "orien_b").alias("way"), (_weight(F.col("state")) - _weight(3 - F.col("state"))).alias("loss"))
    while True:
        now = way()
        sides = _circles(now, tris).select("a", "b", "c", F.inline(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("ab", "bc", "ac")))))
        turns = sides.join(now.where("not turned"), ["u", "v"])
        worst = turns.groupBy("a", "b", "c").agg(F.min_by(F.struct("u", "v"), F.struct("loss", "u", "v")).alias("t")).select("t.*").distinct()
        # One turn per contig and round and one per bundle at all, so that turns don't undo one another.
        first = materialize(worst.groupBy("u").agg(F.min("v").alias("v")).withColumn("turn", F.lit(True)), "solve-turns")
        if first.isEmpty():
            break
        marked = full.join(first, ["u", "v"], "left").withColumn("turn", F.coalesce("turn", F.lit(False)))
        marked = marked.withColumns({"state": F.when(F.col("turn"), 3 - F.col("state")).otherwise(F.col("state")), "turned": F.col("turned") | F.col("turn")})
        full = materialize(marked.select(full.columns), "solve-full")
    left = materialize(_circles(way(), tris), "solve-circles")
    if left.isEmpty():
        return full.drop("turned")

    number = materialize(triangle_edges(tris).withColumn("e", F.monotonically_increasing_id()), "solve-sides")
    side = lambda x, y: number.select(F.col("u").alias(x), F.col("v").alias(y), F.col("e").alias(x + y))
    of = materialize(tris.join(side("a", "b"), ["a", "b"]).join(side("b", "c"), ["b", "c"]).join(side("a", "c"), ["a", "c"]), "solve-cluster-triangles")
    parts = G.connected_components(of.select(F.col("ab").alias("u"), F.col("bc").alias("v")).union(of.select("ab", "ac")), "solve-clusters")
    clusters = number.join(parts, number.e == parts.node).select("u", "v", F.col("root").alias("cluster"))
    open_ = left.join(clusters, (left.a == clusters.u) & (left.b == clusters.v)).select("cluster").distinct()
    inside = full.join(clusters.join(open_, "cluster", "left_semi"), ["u", "v"])
    forward = 2 * F.col("orien_a") + F.col("orien_b")
    inside = materialize(inside.select("cluster", "u", "v", forward.alias("forward"), _weight(forward).alias("ahead"), _weight(3 - forward).alias("back")), "solve-inside")
    net = inside.select("cluster", F.inline(F.array(F.struct(F.col("u").alias("n"), (F.col("ahead") - F.col("back")).alias("x")), F.struct(F.col("v").alias("n"), (F.col("back") - F.col("ahead")).alias("x")))))
    net = net.groupBy("cluster", "n").agg(F.sum("x").alias("x"))
    u, v = (net.select("cluster", F.col("n").alias(n), F.struct(-F.col("x"), F.col("n")).alias(f"r{n}")) for n in "uv")
    choice = F.array(F.lit(True), F.lit(False), F.col("ru") < F.col("rv"))  # by number up, by number down, by what leaves less what enters
    ordered = inside.join(u, ["cluster", "u"]).join(v, ["cluster", "v"]).select("cluster", "u", "v", "forward", F.posexplode(choice).alias("way", "ahead_first"), "ahead", "back")
    value = ordered.groupBy("cluster", "way").agg(F.sum(F.when(F.col("ahead_first"), F.col("ahead")).otherwise(F.col("back"))).alias("value"))
    best = value.groupBy("cluster").agg(F.max_by("way", F.struct("value", -F.col("way"))).alias("way"))
    fixed = ordered.join(best, ["cluster", "way"]).select("u", "v", F.when(F.col("ahead_first"), F.col("forward")).otherwise(3 - F.col("forward")).alias("set"))
    return materialize(full.join(fixed, ["u", "v"], "left").withColumn("state", F.coalesce("set", "state").cast("int")).select(full.columns), "solve-full").drop("turned")


def _fixed(edges: DataFrame, orientations: DataFrame | None, directions: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(var, bit) of the contigs and bundles whose value is given, and the bundles (u, v, bit) among them.

    ``orientations`` (node, orien); ``directions`` (idxa, idxb, patha, pathb), in
    which a pair may stand in either order and counts if it has one direction
    and both its contigs have an orientation.
    """
    pairs = edges.select("u", "v", F.lit(0).alias("bit")).limit(0)
    if orientations is None:
        return pairs.select(_direction("u", "v").alias("var"), "bit"), pairs
    known = orientations.where("orien is not null").groupBy("node").agg(F.max("orien").cast("int").alias("bit"))
    if directions is not None:
        turned = F.col("idxa") > F.col("idxb")
        behind = F.when(turned, F.col("patha")).otherwise(F.col("pathb")).cast("int")
        pairs = directions.where("patha + pathb = 1").groupBy(F.least("idxa", "idxb").alias("u"), F.greatest("idxa", "idxb").alias("v")).agg(F.max(behind).alias("bit"))
        for end in "uv":
            pairs = pairs.join(known.select(F.col("node").alias(end)), end, "left_semi")
        pairs = pairs.join(edges.select("u", "v"), ["u", "v"], "left_semi").select("u", "v", "bit")
    of_pairs = pairs.select(_direction("u", "v").alias("var"), "bit")
    return of_pairs.union(known.select(_orientation("node").alias("var"), "bit")), pairs


def _start(edges: DataFrame, tris: DataFrame, fixed: DataFrame, core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(var, bit) of the ``core``, from a good solution of the components that have some of it, and these bundles (u, v)."""
    members = G.connected_components(edges.select("u", "v"), "solve-components")
    touched = members.select("node", _orientation("node").alias("var")).union(edges.select("u", _direction("u", "v"))).join(core, "var", "left_semi")
    roots = members.join(touched.select("node").distinct(), "node").select("root").distinct()
    inside = members.join(roots, "root", "left_semi").select(F.col("node").alias("u"))
    hard = materialize(edges.join(inside, "u", "left_semi"), "solve-hard")
    given = fixed.where("var like 'o:%'")
    turned = orient(hard, G.rooted_forest(hard.select("u", "v"))).withColumn("var", _orientation("node")).join(given, "var", "left")
    pinned = turned.where("bit is not null").select("node")
    orien = improve(hard, turned.select("node", F.coalesce("bit", "orien").alias("orien")), pinned)
    u, v = (orien.select(F.col("node").alias(x), F.col("orien").alias(f"orien_{y}")) for x, y in (("u", "a"), ("v", "b")))
    state = _best_state(F.col("orien_a") == F.col("orien_b"))
    told = fixed.where("var like 'd:%'").select("var", F.col("bit").alias("told"))
    ahead = 2 * F.col("orien_a") + F.col("orien_b")
    full = hard.join(u, "u").join(v, "v").withColumn("var", _direction("u", "v")).join(told, "var", "left")
    full = full.withColumns({"state": F.when(F.col("told") == 0, ahead).when(F.col("told") == 1, 3 - ahead).otherwise(state), "kept": F.col("told").isNotNull(), "status": F.lit("heuristic")})
    full = break_circles(full.drop("told"), tris)
    ways = full.select("var", F.when(X.direction("state", "orien_a", "orien_b") == 1, 0).otherwise(1).alias("bit"))
    values = ways.union(orien.select(_orientation("node").alias("var"), F.col("orien").alias("bit")))
    return core.join(values, "var").select("var", "bit"), hard.select("u", "v")


def solve(bundles: DataFrame, max_width: int = 14, orientations: DataFrame | None = None, directions: DataFrame | None = None, max_bundles: int = 2000) -> DataFrame:
    """One row per bundle: u, v, w0..w3, orien_a, orien_b, state, X, Y, weight, status, most, held.

    X is 1 for u to v, Y for v to u.  Components of at most ``max_bundles``
    bundles are solved exactly inside tasks, many a task
    (:func:`.groups.solve_components`), unless they are too wide for that.  The
    others are solved exactly, of whatever
    size, as long as elimination never has to look at more than ``max_width``
    variables besides the one that it takes (:func:`.elimination.eliminate`);
    trees need 1, and cut contigs part what hangs on them.  What is left of wider
    components, their core, takes its values from a search: orientations start
    from the heavier parity along a spanning tree, contigs turn while that adds
    weight (:func:`improve`), and circles of three are broken
    (:func:`break_circles`); all the rest is then best for this core.  The
    bundles of such a component have the status heuristic.  No solution breaks a
    constraint.  ``most`` is the bundle's greatest weight under any state; the
    sum of it bounds the optimum from above.

    ``orientations`` (node, orien) and ``directions`` (idxa, idxb, patha, pathb)
    of an earlier solution are kept: their variables are set before anything is
    eliminated.  ``held`` is false where directions that run in a circle, or
    meet others in a core, could not be kept.
    """
    edges = materialize(canonical_bundles(bundles), "solve-edges")
    forced = orientations is not None
    pairs = edges.select("u", "v", F.lit(0).alias("bit")).limit(0)
    told = edges.withColumns({c: F.lit(None).cast("int") for c in ("told_a", "told_b", "told_way")})
    if forced:
        fixed, pairs = _fixed(edges, orientations, directions)
        fixed = materialize(fixed, "solve-fixed")
        known = orientations.where("orien is not null").groupBy("node").agg(F.max("orien").cast("int").alias("bit"))
        a, b = (known.select(F.col("node").alias(x), F.col("bit").alias(f"told_{y}")) for x, y in (("u", "a"), ("v", "b")))
        told = edges.join(a, "u", "left").join(b, "v", "left").join(pairs.withColumnRenamed("bit", "told_way"), ["u", "v"], "left")
    roots = G.connected_components(edges.select("u", "v"), "solve-components")
    done, left = C.solve_components(told, roots, C.orientations, max_bundles, "solve-done")
    columns = ["u", "v", "w0", "w1", "w2", "w3", "orien_a", "orien_b", "state"]
    full = done.where("orien_a is not null").select(*columns, F.lit("exact").alias("status"), F.col("told_way").alias("want"))
    if left:
        wide = materialize(done.where("orien_a is null").select(edges.columns), "solve-wide")
        rest = _solve_wide(wide, max_width, fixed if forced else None, pairs, directions is not None)
        full = full.unionByName(rest.select(full.columns))
    way = X.direction("state", "orien_a", "orien_b")
    return full.select(
        *columns, F.when(way == 1, 1).otherwise(0).alias("X"), F.when(way == -1, 1).otherwise(0).alias("Y"),
        _weight(F.col("state")).alias("weight"), "status", F.greatest("w0", "w1", "w2", "w3").alias("most"), F.coalesce((way == 1) == (F.col("want") == 0), F.lit(True)).alias("held"),
    )


def _solve_wide(edges: DataFrame, max_width: int, fixed: DataFrame | None, pairs: DataFrame, check: bool) -> DataFrame:
    """Components of ``edges`` solved by rounds of joins: u, v, w0..w3, orien_a, orien_b, state, status, kept, want."""
    tris = materialize(triangles(edges.select(F.col("u").alias("ctg_a_idx"), F.col("v").alias("ctg_b_idx"))), "solve-triangles")
    forced = fixed is not None
    if forced:
        mine = edges.select(F.explode(F.array(_orientation("u"), _orientation("v"), _direction("u", "v"))).alias("var")).distinct()
        fixed = fixed.join(mine, "var", "left_semi")
    else:
        fixed = pairs.select(_direction("u", "v").alias("var"), "bit")
    pairs = pairs.join(edges.select("u", "v"), ["u", "v"], "left_semi")
    named = materialize(_free(edges, triangle_edges(tris).union(pairs.select("u", "v"))), "solve-named")
    problem = tables(named, tris)
    found = E.eliminate(E.condition(problem, fixed) if forced else problem, max_width)
    hard = named.select("u", "v").limit(0)
    if found.core.isEmpty():
        values = found.assign()
    else:
        start, hard = _start(named.drop("free"), tris, fixed, found.core)
        values = found.assign(materialize(start, "solve-core"))
    if forced:
        values = values.join(fixed, "var", "left_anti").union(fixed.select("var", F.col("bit").cast("long")))
    values = materialize(values.select("var", F.col("bit").cast("int").alias("bit")), "solve-values")
    bit = lambda name: values.select(F.col("var").alias(name), F.col("bit").alias(f"is_{name}"))
    full = named.withColumns({"ou": _orientation("u"), "ov": _orientation("v"), "duv": _direction("u", "v")})
    full = full.join(bit("ou"), "ou").join(bit("ov"), "ov").join(bit("duv"), "duv", "left")
    ahead = 2 * F.col("is_ou") + F.col("is_ov")
    state = F.when(F.col("is_duv") == 0, ahead).when(F.col("is_duv") == 1, 3 - ahead).otherwise(_best_state(F.col("is_ou") == F.col("is_ov")))
    full = full.join(hard.withColumn("status", F.lit("heuristic")), ["u", "v"], "left").join(pairs.withColumnRenamed("bit", "want"), ["u", "v"], "left")
    full = full.select(
        "u", "v", "w0", "w1", "w2", "w3", F.col("is_ou").alias("orien_a"), F.col("is_ov").alias("orien_b"), state.cast("int").alias("state"),
        F.coalesce("status", F.lit("exact")).alias("status"), F.col("want").isNotNull().alias("kept"), "want",
    )
    if check:
        # Given directions may run in a circle by themselves, or with the core.
        full = break_circles(full, tris)
    return full


def _used(u: str, v: str) -> F.Column:
    """The variable of whether a bundle is used."""
    return F.concat(F.lit("x:"), F.col(u).cast("string"), F.lit("-"), F.col(v).cast("string"))


def _taken(way: str, rank: str) -> F.Column:
    """The variable of whether a contig's end is taken by the bundles up to the one of this rank."""
    return F.concat(F.lit(f"taken-{way}:"), F.col(rank).cast("string"))


def path_tables(edges: DataFrame, tris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The program whose solutions are paths, over ``edges`` (u, v, w0..w3), as factors; and (var, node) of its variables.

    A bundle is unused or has a direction.  The bundles of a contig stand in a
    row, each with a state of the contig after it: whether its way in and its way
    out are taken; neither is taken twice.  So a contig with many bundles is a
    chain of small tables.  No three used bundles run around.
    """
    name = F.concat(F.lit("e:"), F.col("u").cast("string"), F.lit("-"), F.col("v").cast("string"))
    own = F.array(_pair(_orientation("u"), "su"), _pair(_orientation("v"), "sv"), _pair(_used("u", "v"), "x"), _pair(_direction("u", "v"), "d"))
    ahead = 2 * F.col("su") + F.col("sv")
    worth = F.when(F.col("x") == 1, _weight(F.when(F.col("d") == 0, ahead).otherwise(3 - ahead))).otherwise(0.0)
    out = _explode_bits(edges, "su", "sv", "x", "d").where("x = 1 or d = 0").select(*E.factor(name, own, worth))
    ends = edges.select("u", "v", F.inline(F.array(*(F.struct(F.col(n).alias("node"), F.lit(n == "v").alias("second")) for n in "uv"))))
    ranked = materialize(with_rank(ends, ["node", "u", "v"]), "solve-ends")
    before = ranked.select("node", (F.col("rank") + 1).alias("rank"), F.col("rank").alias("previous"))
    chain = ranked.join(before, ["node", "rank"], "left")
    tried = _explode_bits(chain, "x", "d", "i0", "o0").where("(x = 1 or d = 0) and (previous is not null or (i0 = 0 and o0 = 0))")
    into = F.when(F.col("second"), F.col("x") * (1 - F.col("d"))).otherwise(F.col("x") * F.col("d"))
    tried = tried.withColumn("enters", into).withColumn("leaves", F.col("x") - F.col("enters")).where("enters + i0 <= 1 and leaves + o0 <= 1")
    tried = tried.withColumns({"i1": F.col("enters") + F.col("i0"), "o1": F.col("leaves") + F.col("o0")})
    here = F.array(_pair(_used("u", "v"), "x"), _pair(_direction("u", "v"), "d"), _pair(_taken("i", "rank"), "i1"), _pair(_taken("o", "rank"), "o1"))
    earlier = F.array(_pair(_taken("i", "previous"), "i0"), _pair(_taken("o", "previous"), "o0"))
    scope = F.when(F.col("previous").isNull(), here).otherwise(F.concat(here, earlier))
    out = out.unionByName(tried.select(*E.factor(F.concat(F.lit("c:"), F.col("rank").cast("string")), scope, F.lit(0.0))))
    sides = ("ab", "bc", "ac")
    around = _explode_bits(tris.select("a", "b", "c"), *sides, *(f"x{s}" for s in sides))
    around = around.where(" and ".join(f"(x{s} = 1 or {s} = 0)" for s in sides)).where("xab + xbc + xac < 3 or ab <> bc or ab = ac")
    three = F.array(*(p for s in sides for p in (_pair(_direction(*s), s), _pair(_used(*s), f"x{s}"))))
    out = out.unionByName(around.select(*E.factor(F.concat_ws("-", F.lit("t:"), "a", "b", "c"), three, F.lit(0.0))))
    names = ranked.select("node", F.explode(F.array(_orientation("node"), _used("u", "v"), _direction("u", "v"), _taken("i", "rank"), _taken("o", "rank"))).alias("var"))
    return out, names.select("var", "node").distinct()


def solve_paths(bundles: DataFrame, max_width: int = 14, max_bundles: int = 2000) -> DataFrame:
    """One row per bundle, as :func:`solve` gives it, where bundles may stay unused and no contig has more than one in or out.

    ``state`` is null, and X, Y and ``weight`` are 0, for an unused bundle.
    Exact as far as :func:`solve` is; in components with a core, what belongs to
    the core stays unused, and all the rest is best for that.
    """
    edges = materialize(canonical_bundles(bundles), "solve-edges")
    roots = G.connected_components(edges.select("u", "v"), "solve-components")
    told = edges.withColumns({c: F.lit(None).cast("int") for c in ("told_a", "told_b", "told_way")})
    done, left = C.solve_components(told, roots, C.paths, max_bundles, "solve-done")
    ahead = 2 * F.col("orien_a") + F.col("orien_b")
    state = F.when(F.col("state") >= 0, F.col("state"))
    forward = state == ahead
    full = done.where("orien_a is not null").select(
        "u", "v", "w0", "w1", "w2", "w3", "orien_a", "orien_b", state.alias("state"), F.coalesce(forward.cast("int"), F.lit(0)).alias("X"), F.coalesce((~forward).cast("int"), F.lit(0)).alias("Y"),
        F.coalesce(_weight(state), F.lit(0.0)).alias("weight"), F.lit("exact").alias("status"),
    )
    if not left:
        return full
    rest = _solve_wide_paths(materialize(done.where("orien_a is null").select(edges.columns), "solve-wide"), max_width)
    return full.unionByName(rest.select(full.columns))


def _solve_wide_paths(edges: DataFrame, max_width: int) -> DataFrame:
    """Components of ``edges`` solved by rounds of joins, as :func:`solve_paths` gives them."""
    tris = materialize(triangles(edges.select(F.col("u").alias("ctg_a_idx"), F.col("v").alias("ctg_b_idx"))), "solve-triangles")
    problem, names = path_tables(edges, tris)
    found = E.eliminate(problem, max_width)
    hard = edges.select("u").limit(0)
    if found.core.isEmpty():
        values = found.assign()
    else:
        core = materialize(found.core, "solve-core")
        values = found.assign(core.withColumn("bit", F.lit(0)))
        members = G.connected_components(edges.select("u", "v"), "solve-components")
        roots = members.join(names.join(core, "var").select("node").distinct(), "node").select("root").distinct()
        hard = members.join(roots, "root", "left_semi").select(F.col("node").alias("u"))
    values = materialize(values.select("var", F.col("bit").cast("int").alias("bit")), "solve-values")
    full = edges.withColumns({"ou": _orientation("u"), "ov": _orientation("v"), "xuv": _used("u", "v"), "duv": _direction("u", "v")})
    for name in ("ou", "ov", "xuv", "duv"):
        full = full.join(values.select(F.col("var").alias(name), F.col("bit").alias(f"is_{name}")), name)
    full = full.join(hard.distinct().withColumn("status", F.lit("heuristic")), "u", "left")
    ahead = 2 * F.col("is_ou") + F.col("is_ov")
    state = F.when(F.col("is_xuv") == 1, F.when(F.col("is_duv") == 0, ahead).otherwise(3 - ahead))
    weight = F.when(F.col("is_xuv") == 1, _weight(state)).otherwise(0.0)
    return full.select(
        "u", "v", "w0", "w1", "w2", "w3", F.col("is_ou").alias("orien_a"), F.col("is_ov").alias("orien_b"), state.cast("int").alias("state"),
        (F.col("is_xuv") * (1 - F.col("is_duv"))).alias("X"), (F.col("is_xuv") * F.col("is_duv")).alias("Y"), weight.alias("weight"), F.coalesce("status", F.lit("exact")).alias("status"),
    )


def _circles(way: DataFrame, tris: DataFrame) -> DataFrame:
    """(a, b, c): triangles whose bundles run in a circle."""
    side = lambda x, y: way.select(F.col("u").alias(x), F.col("v").alias(y), F.col("way").alias(x + y))
    met = tris.join(side("a", "b"), ["a", "b"]).join(side("b", "c"), ["b", "c"]).join(side("a", "c"), ["a", "c"])
    return met.where("ab = bc and ac = -ab").select("a", "b", "c")


def violations(solution: DataFrame, tris: DataFrame) -> DataFrame:
    """(rule, n): how many rows of a solution break each constraint."""
    s = solution.withColumn("odd", F.col("orien_a") != F.col("orien_b"))
    way = s.select("u", "v", (F.col("X") - F.col("Y")).alias("way"))
    rules = {
        "xor": s.where(F.col("odd") != F.col("state").isin(1, 2)), "one direction": s.where("X + Y <> 1"),
        "direction": s.where(X.direction("state", "orien_a", "orien_b") != F.col("X") - F.col("Y")), "no circle of three": _circles(way, tris),
    }
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


def directed_ways(solution: DataFrame) -> DataFrame:
    """(src, dst) of solved bundles with a direction."""
    forward = F.col("X") == 1
    return solution.where("X + Y > 0").select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("dst"))


def directed_edges(solution: DataFrame) -> DataFrame:
    """(src, dst, weight) of solved bundles; without weight 0, then cut to a whole number."""
    forward = F.col("X") == 1
    rows = solution.where("X + Y > 0 and weight <> 0")
    return rows.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("dst"), F.col("weight").cast("long").alias("weight"))


def previous_solution(solution: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (idxa, idxb, oriena, orienb, patha, pathb) of a solution for the bundles whose pair is one of the final ``edges`` (src, dst), in either order."""
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    kept = solution.join(pairs, ["u", "v"], "left_semi")
    long = lambda c, n: F.col(c).cast("long").alias(n)
    return kept.select(long("u", "idxa"), long("v", "idxb"), long("orien_a", "oriena"), long("orien_b", "orienb"), long("X", "patha"), long("Y", "pathb"))


def apply_partial(current: DataFrame, partial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orientations (node, orien) of ``current`` with those of ``partial`` over them, and the nodes on which they differ."""
    met = current.join(partial.withColumnRenamed("orien", "new"), "node", "full_outer")
    conflicts = met.where("orien is not null and new is not null and orien <> new").select("node", "orien", "new")
    return met.select("node", F.coalesce("new", "orien").alias("orien")), conflicts


def apply_with_flip(current: DataFrame, partial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`apply_partial` for several partial solutions (part, node, orien) at once; one that disagrees with ``current`` is turned around first.

    Returns the orientations (node, orien) and (part, turned, conflicts): whether
    the part was turned, and the nodes on which it differs even so; there the
    part wins, the one with the largest number of several.
    """
    met = partial.join(current.withColumnRenamed("orien", "old"), "node", "left")
    turn = met.groupBy("part").agg(F.count_if(F.col("old") != F.col("orien")).alias("differ"), F.count_if(F.col("old") == F.col("orien")).alias("agree"))
    turn = turn.select("part", (F.col("differ") > 0).alias("turned"), F.when(F.col("differ") > 0, F.col("agree")).otherwise(0).alias("conflicts"))
    placed = partial.join(turn, "part").select("node", "part", F.when(F.col("turned"), 1 - F.col("orien")).otherwise(F.col("orien")).alias("orien"))
    new = placed.groupBy("node").agg(F.max_by("orien", "part").alias("new"))
    return current.join(new, "node", "full_outer").select("node", F.coalesce("new", "orien").alias("orien")), turn


def apply_partial_bundles(current: DataFrame, partial: DataFrame) -> DataFrame:
    """Solved bundles (u, v, state, X, Y) of ``current`` with those of ``partial`` over them; a pair that only one has stays."""
    columns = ("state", "X", "Y")
    new = partial.select("u", "v", *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("given"))
    met = current.select("u", "v", *columns).join(new, ["u", "v"], "full_outer")
    return met.select("u", "v", *(F.when(F.col("given"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def apply_bundles_with_flip(current: DataFrame, partial: DataFrame, turned: DataFrame) -> DataFrame:
    """As :func:`apply_partial_bundles` for several partial solutions (part, u, v, state, X, Y) at once, by the part with the largest number.

    ``turned`` (part, turned) is what :func:`apply_with_flip` found: a part that
    is turned around keeps its states and has its directions reversed; a bundle
    without one stays without.
    """
    reverse = F.coalesce(F.col("turned"), F.lit(False)) & ((F.col("X") == 1) | (F.col("Y") == 1))
    placed = partial.join(turned.select("part", "turned"), "part", "left")
    placed = placed.select("part", "u", "v", "state", *(F.when(reverse, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in "XY"))
    last = placed.groupBy("u", "v").agg(F.max_by(F.struct("state", "X", "Y"), "part").alias("b")).select("u", "v", "b.*")
    return apply_partial_bundles(current, last)


def merge_partial(current: DataFrame, partial: DataFrame) -> DataFrame:
    """Solved bundles (u, v, state, X, Y) of both: the first state wins, a set direction stays set, and of both X is kept."""
    both = current.select("u", "v", "state", "X", "Y", F.lit(0).alias("from")).unionByName(partial.select("u", "v", "state", "X", "Y", F.lit(1).alias("from")))
    merged = both.groupBy("u", "v").agg(F.min_by("state", "from").alias("state"), F.max("X").alias("X"), F.max("Y").alias("Y"))
    return merged.withColumn("Y", F.when(F.col("X") == 1, 0).otherwise(F.col("Y")))

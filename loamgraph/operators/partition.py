"""Communities of a weighted graph: phased local moves, refinement and aggregation, the same for any number of tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored

#: Edge ends up to which a level is one task's work; a larger graph's phases are joins. The result is the same.
BLOCK_ENDS = 2_000_000
#: Phases of a sweep, as a power of two; sweeps of a level, at most, and the share of nodes that must move for another.
PHASE_BITS, SWEEPS, MOVED = 3, 10, 0.001
#: The share of a level's nodes that must join others for a further level.
JOINED = 0.02
#: Times that all levels are gone through, each from the communities of the one before, and the gain in modularity that another one needs.
ROUNDS, GAIN = 3, 1e-4
#: What a move must gain.
LEAST = 1e-12


def _phase(draw, slot: int):  # noqa: ANN001
    """Which of a sweep's phases a node moves in: the lowest bits of its draw, turned by `slot` bits; of a column or an array."""
    slot, low = slot % 64, (1 << PHASE_BITS) - 1
    if isinstance(draw, Column):
        turned = F.shiftrightunsigned(draw, slot).bitwiseOR(F.shiftleft(draw, 64 - slot)) if slot else draw
        return turned.bitwiseAND(F.lit(low))
    d = draw.view(np.uint64)
    turned = (d >> np.uint64(slot)) | (d << np.uint64(64 - slot)) if slot else d
    return turned & np.uint64(low)


#: Bits by which a level's phases and a round's are turned against the one before.
LEVEL_TURN, ROUND_TURN = 7, 17


# One task's work, in arrays: nodes are 0, 1, ... in the order of their numbers, labels are nodes.


def best_moves(src, dst, w, k, label, load, total, active, fence=None):  # noqa: ANN001
    """(nodes, labels) of active nodes that gain by a move to a neighbour's community, each the one that gains most, ties to the smaller label; with a fence, within it."""
    edge = active[src] if fence is None else active[src] & (fence[src] == fence[dst])
    key = src[edge] * len(label) + label[dst[edge]]
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[edge][order]
    if not len(key):
        return key, key
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tie, s, c = np.add.reduceat(w, first), key[first] // len(label), key[first] % len(label)
    own = c == label[s]
    gain = tie - k[s] * (load[c] - np.where(own, k[s], 0.0)) / total
    here = -(k * (load[label] - k) / total)
    here[s[own]] = gain[own]
    order = np.lexsort((-c, gain, s))
    last = order[np.r_[s[order][1:] != s[order][:-1], True]]
    s, c, gain = s[last], c[last], gain[last]
    moves = (gain > here[s] + LEAST) & (c != label[s])
    return s[moves], c[moves]


def move_in_task(src, dst, w, k, label, draw, total, active=None, turn=0):  # noqa: ANN001
    """(labels, whether each node moved) after local moves; with `active`, only those nodes move, then those that moved and their neighbours."""
    n = len(label)
    label, load, ever = label.copy(), np.bincount(label, k, minlength=n), np.zeros(n, bool)
    awake = np.ones(n, bool) if active is None else active.copy()
    for sweep in range(SWEEPS):
        moved = np.zeros(n, bool)
        for phase in range(1 << PHASE_BITS):
            v, c = best_moves(src, dst, w, k, label, load, total, awake & (_phase(draw, turn + PHASE_BITS * sweep) == phase))
            np.add.at(load, label[v], -k[v])
            np.add.at(load, c, k[v])
            label[v] = c
            moved[v] = True
        ever |= moved
        if moved.sum() <= MOVED * awake.sum():
            break
        if active is not None:
            awake = moved.copy()
            awake[dst[moved[src]]] = True
    return label, ever


def refine_in_task(src, dst, w, k, fence, draw, total, turn=0):  # noqa: ANN001
    """Labels of parts of each community (fence): nodes that are well tied to their community, and still alone, join a part that gains most."""
    n = len(k)
    label, load, size = np.arange(n), k.copy(), np.ones(n, np.int64)
    inner = fence[src] == fence[dst]
    ties = np.bincount(src[inner], w[inner], minlength=n)
    well = ties >= k * (np.bincount(fence, k, minlength=n)[fence] - k) / total
    for phase in range(1 << PHASE_BITS):
        alone = (size[label] == 1) & (label == np.arange(n))
        v, c = best_moves(src, dst, w, k, label, load, total, well & alone & (_phase(draw, turn + PHASE_BITS * SWEEPS) == phase), fence)
        stays = ~np.isin(c, v)
        v, c = v[stays], c[stays]
        np.add.at(load, label[v], -k[v])
        np.add.at(size, label[v], -1)
        np.add.at(load, c, k[v])
        np.add.at(size, c, 1)
        label[v] = c
    return label


def levels_in_task(src, dst, w, k, label, draw, total, active=None, refined=True, turn=0):  # noqa: ANN001
    """For each level (the node of that level, the label) of each first node, and which of them moved in the first level."""
    at = num = np.arange(len(k))
    out, first = [], None
    while True:
        label, moved = move_in_task(src, dst, w, k, label, draw, total, active, turn)
        sub = refine_in_task(src, dst, w, k, label, draw, total, turn) if refined else label
        out.append((num[at], num[label][at]))
        first = moved if first is None else first
        parts = np.unique(sub)
        if len(sub) - len(parts) <= JOINED * len(sub):
            return out, first
        inv = np.searchsorted(parts, sub)
        at, k, num, draw = inv[at], np.bincount(inv, k), num[parts], draw[parts]
        x, y = inv[src], inv[dst]
        apart = x != y
        key, where = np.unique(x[apart] * len(parts) + y[apart], return_inverse=True)
        src, dst, w = key // max(len(parts), 1), key % max(len(parts), 1), np.bincount(where, w[apart], minlength=len(key))
        if not len(key):
            return out, first
        # Each part begins in its community, which is named by its first part.
        whole = label[parts]
        least = np.full(int(label.max()) + 1, len(parts))
        np.minimum.at(least, whole, np.arange(len(parts)))
        label, active, refined, turn = least[whole], None, True, turn + LEVEL_TURN


LEVEL = "node long, label long, sub long, moved boolean"


def _together(ends: DataFrame, nodes: DataFrame, make: Callable[..., dict], schema: str) -> DataFrame:
    """make(ids, src, dst, w, k, label, draw, active) of a graph that fits one task, as a written table."""

    def run(edges: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("node")
        ids, k, draw, label = (own.column(c).to_numpy() for c in ("node", "k", "draw", "label"))
        at = lambda values: np.searchsorted(ids, values)
        active = own.column("active").to_numpy(zero_copy_only=False) if "active" in own.column_names else None
        return pa.table(make(ids, at(edges.column("src").to_numpy()), at(edges.column("dst").to_numpy()), edges.column("w").to_numpy(), k, at(label), draw, active))

    one = lambda rows: rows.withColumn("one", F.lit(0)).groupBy("one")
    return stored(one(ends).cogroup(one(nodes)).applyInArrow(lambda key, a, b: run(a, b), schema))


def _rest_in_one_task(ends: DataFrame, nodes: DataFrame, total: float, refined: bool, turn: int) -> DataFrame:
    """node, at, label (arrays: a level each), moved of all levels that are left."""

    def make(ids, src, dst, w, k, label, draw, active) -> dict:  # noqa: ANN001
        levels, moved = levels_in_task(src, dst, w, k, label, draw, total, active, refined, turn)
        listed = lambda i: pa.array(list(np.stack([ids[level[i]] for level in levels], axis=1)), pa.list_(pa.int64()))
        return {"node": ids, "at": listed(0), "label": listed(1), "moved": moved}

    return _together(ends, nodes, make, "node long, at array<long>, label array<long>, moved boolean")


# The same in joins.


def _moves(ends: DataFrame, state: DataFrame, active: DataFrame, total: float, fenced: bool) -> DataFrame:
    """node, new of best_moves(): state has node, label, k and, fenced, fence; active some of its rows."""
    far = state.select(F.col("node").alias("dst"), F.col("label").alias("to"), *([F.col("fence").alias("far")] if fenced else []))
    near = active.select(F.col("node").alias("src"), "label", "k", *(["fence"] if fenced else []))
    rows = ends.join(near, "src").join(far, "dst")
    if fenced:
        rows = rows.where("fence = far")
    loads = state.groupBy(F.col("label").alias("to")).agg(F.sum("k").alias("load"))
    ties = rows.groupBy("src", "label", "k", "to").agg(F.sum("w").alias("tie")).join(loads, "to")
    own = F.col("to") == F.col("label")
    gain = F.col("tie") - F.col("k") * (F.col("load") - F.when(own, F.col("k")).otherwise(0.0)) / F.lit(total)
    best = ties.withColumn("gain", gain).groupBy("src", "label", "k").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"))).alias("best"), F.max(F.when(own, F.col("gain"))).alias("stay"))
    best = best.join(loads.select(F.col("to").alias("label"), "load"), "label")
    here = F.coalesce("stay", -(F.col("k") * (F.col("load") - F.col("k")) / F.lit(total)))
    best = best.where((F.col("best.gain") > here + LEAST) & (-F.col("best.to") != F.col("label")))
    return stored(best.select(F.col("src").alias("node"), (-F.col("best.to")).alias("new")))


def _relabelled(state: DataFrame, moves: DataFrame) -> DataFrame:
    changed = state.join(moves, "node", "left")
    moved = [(F.col("moved") | F.col("new").isNotNull()).alias("moved")] if "moved" in state.columns else []
    return stored(changed.select(*(F.coalesce("new", "label").alias("label") if c == "label" else F.col(c) for c in state.columns if c != "moved"), *moved))


def one_level(ends: DataFrame, nodes: DataFrame, total: float, refined: bool = True, turn: int = 0) -> DataFrame:
    """LEVEL of nodes (node, label, k, draw and, if only some may move at first, active) under ends (src, dst, w: both directions, no loops)."""
    state = nodes.drop("active").withColumn("moved", F.lit(False))
    frontier = nodes.where("active").select("node") if "active" in nodes.columns else None
    for sweep in range(SWEEPS):
        awake = nodes.count() if frontier is None else frontier.count()
        found = None
        for phase in range(1 << PHASE_BITS):
            active = state.where(_phase(F.col("draw"), turn + PHASE_BITS * sweep) == phase)
            moves = _moves(ends, state, active if frontier is None else active.join(frontier, "node", "left_semi"), total, False)
            if not moves.isEmpty():
                state = _relabelled(state, moves)
                found = moves.select("node") if found is None else found.unionByName(moves.select("node"))
        moved = stored(found) if found is not None else None
        if moved is None or moved.count() <= MOVED * awake:
            break
        if frontier is not None:
            near = ends.join(moved.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
            frontier = stored(near.unionByName(moved).distinct())
    if not refined:
        return stored(state.select("node", "label", F.col("label").alias("sub"), "moved"))
    parts = state.select("node", F.col("label").alias("fence"), F.col("node").alias("label"), "k", "draw")
    whole = parts.groupBy("fence").agg(F.sum("k").alias("all"))
    side = lambda c: parts.select(F.col("node").alias(c), F.col("fence").alias(f"f{c}"))
    inner = ends.join(side("src"), "src").join(side("dst"), "dst").where("fsrc = fdst").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("ties"))
    well = parts.join(inner, "node", "left").join(whole, "fence").where(F.coalesce("ties", F.lit(0.0)) >= F.col("k") * (F.col("all") - F.col("k")) / F.lit(total)).select("node")
    well = stored(well)
    parts = stored(parts)
    for phase in range(1 << PHASE_BITS):
        sizes = parts.groupBy("label").agg(F.count("*").alias("held")).where("held = 1").select("label")
        alone = parts.where(F.col("node") == F.col("label")).join(sizes, "label", "left_semi").join(well, "node", "left_semi").where(_phase(F.col("draw"), turn + PHASE_BITS * SWEEPS) == phase)
        moves = _moves(ends, parts, alone, total, True)
        moves = moves.join(moves.select(F.col("node").alias("new")), "new", "left_anti")
        if not moves.isEmpty():
            parts = _relabelled(parts, moves)
    return stored(state.select("node", "label", "moved").join(parts.select("node", F.col("label").alias("sub")), "node").select("node", "label", "sub", "moved"))


def without_leaves(ends: DataFrame, nodes: DataFrame, alike: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ends, nodes with k, leaves: node, hub, w) of a graph whose leaves are taken into their hubs: nodes with one neighbour, which has others.

    A leaf is in its neighbour's community wherever modularity is greatest, so hubs and leaves move as one. With `alike`, only leaves that have their hub's label are taken;
    a hub is active if it or a leaf is.
    """
    degrees = stored(ends.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.sum("w").alias("k"), F.min("dst").alias("hub")))
    leaves = degrees.where("n = 1").select("node", "hub", F.col("k").alias("w")).join(degrees.where("n > 1").select(F.col("node").alias("hub")), "hub", "left_semi")
    label = nodes.select("node", "label")
    if alike:
        leaves = leaves.join(label, "node").join(label.select(F.col("node").alias("hub"), "label"), ["hub", "label"], "left_semi")
    leaves = stored(leaves.select("node", "hub", "w"))
    gone = leaves.select("node")
    left = stored(ends.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    some = "active" in nodes.columns
    told = leaves.join(nodes.select("node", "active"), "node") if some else leaves
    more = told.groupBy(F.col("hub").alias("node")).agg(F.sum("w").alias("more"), *([F.max("active").alias("woken")] if some else []))
    own = nodes.join(gone, "node", "left_anti").join(degrees.select("node", "k"), "node").join(more, "node", "left")
    awake = [(F.col("active") | F.coalesce("woken", F.lit(False))).alias("active")] if some else []
    return left, stored(own.select("node", "label", (F.col("k") + F.coalesce("more", F.lit(0.0))).alias("k"), *awake)), leaves


def with_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows (node and the rest), and for each leaf those of its hub."""
    held = leaves.select(F.col("node").alias("leaf"), F.col("hub").alias("node")).join(rows, "node")
    return rows.unionByName(held.drop("node").withColumnRenamed("leaf", "node"))


def modularity_of(ends: DataFrame, nodes: DataFrame, labels: DataFrame, total: float, inside: float) -> float:
    """Of labels (node, label): the share of edge ends inside, `inside` being those within nodes, less what the nodes' k alone would put there."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    own = ends.join(side("src"), "src").join(side("dst"), "dst").where("lsrc = ldst").agg(F.sum("w")).first()[0] or 0.0
    each = nodes.select("node", "k").join(labels, "node").groupBy("label").agg(F.sum("k").alias("k"))
    return (own + inside) / total - (each.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0) / total**2


def levels_of(ends: DataFrame, nodes: DataFrame, total: float, turn: int, block_ends: int | None = None, refined: bool = True) -> list[DataFrame]:
    """node, at, label, moved (in the first level) of the first nodes after each level, `at` being its node that they are in: local moves, parts of each community, then parts as nodes of the next level that begin in their communities.

    nodes: node, label, k if it isn't the sum of the node's ends, and active if only some may move in the first level. Once a level fits one task, it and all further ones are done there.
    """
    most = BLOCK_ENDS if block_ends is None else block_ends
    out, place = [], nodes.select("node", F.col("node").alias("at"))
    if "k" not in nodes.columns:
        nodes = nodes.join(ends.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "node")
    nodes = stored(nodes.withColumn("draw", F.xxhash64("node")))
    while not ends.isEmpty():
        if ends.count() <= most:
            rest = _rest_in_one_task(ends, nodes, total, refined or bool(out), turn)
            both = place.join(rest.withColumnsRenamed({"node": "_node", "at": "_at"}).withColumnRenamed("_node", "at"), "at")
            both = stored(both.select("node", F.col("_at").alias("at"), "label", "moved"))
            steps = both.agg(F.max(F.size("at"))).first()[0] or 0
            return out + [both.select("node", F.col("at")[i].alias("at"), F.col("label")[i].alias("label"), "moved") for i in range(steps)]
        found = one_level(ends, nodes, total, refined or bool(out), turn)
        here = place.join(found.select(F.col("node").alias("at"), "label", "sub", "moved"), "at")
        out.append(stored(here.select("node", "at", "label", "moved")))
        counts = found.agg(F.count("*").alias("n"), F.countDistinct("sub").alias("parts")).first()
        if counts["n"] - counts["parts"] <= JOINED * counts["n"]:
            break
        turn += LEVEL_TURN
        place = stored(here.select("node", F.col("sub").alias("at")))
        side = lambda c: found.select(F.col("node").alias(c), F.col("sub").alias(f"s{c}"))  # noqa: B023, E731
        apart = ends.join(side("src"), "src").join(side("dst"), "dst").where("ssrc <> sdst")
        ends = stored(apart.groupBy(F.col("ssrc").alias("src"), F.col("sdst").alias("dst")).agg(F.sum("w").alias("w")))
        firsts = found.groupBy("label").agg(F.min("sub").alias("first"))
        grown = nodes.select("node", "k").join(found.select("node", "sub", "label"), "node").join(firsts, "label")
        nodes = stored(grown.groupBy(F.col("sub").alias("node")).agg(F.min("first").alias("label"), F.sum("k").alias("k")).withColumn("draw", F.xxhash64("node")))
    return out


def communities_of(ends: DataFrame, nodes: DataFrame, block_ends: int | None = None, rounds: int = ROUNDS, told: Callable[[int, int, float], None] | None = None) -> list[DataFrame]:
    """(node, at, label) of the levels of the best round: each level's nodes `at` are parts of the next one's, and the last level's labels the communities. nodes: node and label to begin with. told() hears of each round's number, levels and modularity."""
    ends = stored(ends)
    total = ends.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return [nodes.select("node", F.col("node").alias("at"), "label")]
    ends, nodes, leaves = without_leaves(ends, nodes)
    inside = 2 * (leaves.agg(F.sum("w")).first()[0] or 0.0)
    best, found = -1.0, []
    for turn in range(rounds):
        each = [x.select("node", "at", "label") for x in levels_of(ends, nodes, total, ROUND_TURN * turn, block_ends)]
        each = each or [nodes.select("node", F.col("node").alias("at"), "label")]
        value = modularity_of(ends, nodes, each[-1].select("node", "label"), total, inside)
        if told:
            told(turn, len(each), value)
        gained = value > best + GAIN
        if value > best:
            best, found = value, each
        if not gained:
            break
        firsts = each[-1].groupBy("label").agg(F.min("node").alias("first"))
        nodes = stored(each[-1].join(firsts, "label").select("node", F.col("first").alias("label")).join(nodes.select("node", "k"), "node"))
    return [with_leaves(x, leaves) for x in found]

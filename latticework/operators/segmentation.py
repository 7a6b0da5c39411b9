"""Persistence segmentation, merge trees and splits of label fields.

Regions merge only between neighbours at or above the threshold, so the connected components of
that set never interact: they are found with joins, and the order-dependent sweep runs per
component in an Arrow-fed grouped function.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.lattice import forward, neighbor_pairs, offsets
from latticework.operators.labels import first_seen_mapping
from latticework.operators.regions import connected_components
from latticework.sources.staging import cut, drop_cut


class Forest:
    """Disjoint sets of 0..n-1 with path halving; the larger set's root stays."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> int:
        i, j = self.find(i), self.find(j)
        if i != j:
            if self.size[i] < self.size[j]:
                i, j = j, i
            self.parent[j] = i
            self.size[i] += self.size[j]
        return i


@dataclass(frozen=True)
class Rule:
    """When two regions that meet may merge: one lasts no longer than ``persistence`` or is under ``min_size``.

    ``mode``: 'absolute', 'relative' (persistence times width) or 'adaptive' (a region's height over
    its height above the field's minimum). ``order``: 'value' or 'majority' of the neighbours.
    """

    persistence: float = 0.0
    min_size: int = 0
    order: str = "majority"
    mode: str = "absolute"
    width: float = 1.0
    floor: float = 0.0

    def merges(self, top1: float, n1: int, top2: float, n2: int, at: float) -> bool:
        if top1 < at or top2 < at:
            return False
        limit = self.persistence * (self.width if self.mode == "relative" else 1.0)

        def lasting(top):
            if self.mode == "adaptive":
                return (top - at) / (top - self.floor) if top > self.floor else 0.0
            return top - at

        return lasting(top1) <= limit or n1 < self.min_size or lasting(top2) <= limit or n2 < self.min_size


def remembered_persistence(persistence: float, width: float, mode: str) -> float:
    """A persistence as a share of the width, as kept when mode or range change; only absolute ones need it."""
    return persistence / width if mode == "absolute" and width else persistence


def reapplied_persistence(share: float, width: float, mode: str) -> float:
    return share * width if mode == "absolute" else share


class Grid:
    """The voxels of one group in descending order of (value, idx), and who is beside whom."""

    def __init__(self, t: pd.DataFrame, kind: int, value: str = "value", ascending: bool = False):
        sign = 1 if ascending else -1
        order = np.lexsort((sign * t["idx"].to_numpy(), sign * t[value].to_numpy()))
        self.idx = t["idx"].to_numpy()[order]
        self.value = t[value].to_numpy()[order].astype(float)
        xyz = np.stack([t[c].to_numpy()[order] for c in "xyz"], 1).astype(np.int64)
        lo = xyz.min(0) - 1
        span = xyz.max(0) - lo + 2
        key = lambda p: ((p[:, 2] - lo[2]) * span[1] + (p[:, 1] - lo[1])) * span[0] + (p[:, 0] - lo[0])
        own = key(xyz)
        by = np.argsort(own)
        near = []
        for o in offsets(kind):
            k = key(xyz + np.array(o))
            at = np.minimum(np.searchsorted(own[by], k), len(by) - 1)
            near.append(np.where(own[by][at] == k, by[at], -1))
        self.near = np.stack(near, 1)

    def earlier(self, i: int) -> list[int]:
        """Neighbours that come before i in the order."""
        return [j for j in self.near[i].tolist() if 0 <= j < i]


def _ranked(found: list[int], grid: Grid, sets: Forest, order: str) -> list[int]:
    """Neighbours by value, or by how many of them are in the same region; ties as enumerated."""
    if order == "value":
        return sorted(found, key=lambda j: -grid.value[j])
    roots = [sets.find(j) for j in found]
    return [j for j, _ in sorted(zip(found, roots), key=lambda p: -roots.count(p[1]))]


def sweep(grid: Grid, rule: Rule) -> Forest:
    """Grow regions downwards; where they meet, the rule decides."""
    sets = Forest(len(grid.idx))
    top = grid.value.copy()
    for i, at in enumerate(grid.value):
        for j in _ranked(grid.earlier(i), grid, sets, rule.order):
            a, b = sets.find(i), sets.find(j)
            if a != b and rule.merges(top[a], sets.size[a], top[b], sets.size[b], at):
                best = max(top[a], top[b])
                top[sets.union(a, b)] = best
    return sets


def _joined_cells(xyz: np.ndarray, shifts) -> np.ndarray:
    """For each cell (n, 3) the first of its connected component: hooks to smaller numbers and pointer jumps."""
    lo = xyz.min(0) - 1
    span = xyz.max(0) - lo + 2
    key = lambda p: ((p[:, 2] - lo[2]) * span[1] + (p[:, 1] - lo[1])) * span[0] + (p[:, 0] - lo[0])
    own = key(xyz)
    by = np.argsort(own)
    a, b = [], []
    for o in shifts:
        k = key(xyz + np.array(o))
        at = np.minimum(np.searchsorted(own[by], k), len(by) - 1)
        hit = np.flatnonzero(own[by][at] == k)
        a.append(hit)
        b.append(by[at[hit]])
    a, b, up = np.concatenate(a), np.concatenate(b), np.arange(len(xyz))
    while (apart := up[a] != up[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(up[a], up[b]), np.minimum(up[a], up[b]))
        while (up[up] != up).any():
            up = up[up]
    return up


def superlevel_components(voxels: DataFrame, threshold: float, kind: str = "26", value: str = "value", brick: int = 64) -> DataFrame:
    """(idx, x, y, z, value, cc): voxels at or above the threshold with the smallest idx of their connected component.

    Components are found within bricks first, one task's work each; then only pairs of voxels across
    the bricks' faces are joined, and the graph of the bricks' components is what joins iterate over.
    """
    cell = [F.floor(F.col(c) / brick).cast("int").alias("b" + c) for c in "xyz"]
    v = voxels.where(F.col(value) >= threshold).select("idx", "x", "y", "z", F.col(value).cast("double").alias(value), *cell)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("idx", ignore_index=True)
        return t.assign(local=t["idx"].to_numpy()[_joined_cells(t[["x", "y", "z"]].to_numpy(np.int64), forward(kind))])

    v = cut(v.groupBy("bx", "by", "bz").applyInPandas(run, f"idx long, x int, y int, z int, {value} double, bx int, by int, bz int, local long"))
    face = " or ".join(f"{c} % {brick} in (0, {brick - 1})" for c in "xyz")
    rim = v.where(face).select("idx", "x", "y", "z", "local", F.struct("bx", "by", "bz").alias("own"))
    seams = neighbor_pairs(rim, forward(kind), ("local", "own"), {"other": "local", "its": "own"}).where("own <> its")
    seams = seams.select(F.col("local").alias("src"), F.col("other").alias("dst")).distinct()
    c = connected_components(v.select(F.col("local").alias("label")).distinct(), seams)
    return v.join(c.select(F.col("label").alias("local"), F.col("component").alias("cc")), "local").select("idx", "x", "y", "z", value, "cc")


def segment(voxels: DataFrame, threshold: float, rule: Rule = Rule(), kind: int = 26, value: str = "value") -> DataFrame:
    """(idx, label): regions numbered from 1 by their first voxel, 0 under the threshold."""
    if rule.mode == "adaptive":
        low = voxels.agg(F.min(value)).first()[0]
        rule = replace(rule, floor=float(low or 0.0))
    parts = superlevel_components(voxels, threshold, "26", value).select("cc", "idx", "x", "y", "z", F.col(value).alias("value"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        g = Grid(t, kind)
        s = sweep(g, rule)
        return pd.DataFrame({"idx": g.idx, "component": [int(g.idx[s.find(i)]) for i in range(len(g.idx))]})

    regions = cut(parts.groupBy("cc").applyInPandas(run, "idx long, component long"))
    named = regions.join(first_seen_mapping(regions), "component").select("idx", "label")
    return voxels.select("idx").join(named, "idx", "left").fillna(0, ["label"])


def segment_count(labels: DataFrame) -> DataFrame:
    return labels.where("label > 0").agg(F.count_distinct("label").alias("segments"))


# ---------------------------------------------------------------- merge trees


def tree_edges(voxels: DataFrame, threshold: float, split: bool = False, kind: int = 14, value: str = "value") -> DataFrame:
    """(cc, lower, higher) edges of the augmented join tree (or split tree) of every component.

    Each voxel is tied to the last voxel of every region that it joins.
    """
    parts = superlevel_components(voxels, threshold, "26", value).select("cc", "idx", "x", "y", "z", F.col(value).alias("value"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        g = Grid(t, kind, ascending=split)
        s, tip, out = Forest(len(g.idx)), list(range(len(g.idx))), []
        for i in range(len(g.idx)):
            for j in g.earlier(i):
                a, b = s.find(i), s.find(j)
                if a != b:
                    out.append((t["cc"].iloc[0], g.idx[i], g.idx[tip[b]]))
                    tip[s.union(a, b)] = i
        e = pd.DataFrame(out, columns=["cc", "lower", "higher"])
        return e.rename(columns={"lower": "higher", "higher": "lower"})[["cc", "lower", "higher"]] if split else e

    return parts.groupBy("cc").applyInPandas(run, "cc long, lower long, higher long")


def contour_tree(voxels: DataFrame, threshold: float, kind: int = 14, value: str = "value") -> DataFrame:
    """(cc, lower, higher) edges of the augmented contour tree: join and split tree, leaf by leaf."""
    tag = lambda split, tree: tree_edges(voxels, threshold, split, kind, value).withColumn("tree", F.lit(tree))
    both = tag(False, "join").unionByName(tag(True, "split"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        up, down = {}, {}  # join tree: children above; split tree: children below
        below, above = {}, {}
        for tree, lo, hi in zip(t["tree"], t["lower"], t["higher"]):
            if tree == "join":
                up.setdefault(lo, set()).add(hi)
                below[hi] = lo
            else:
                down.setdefault(hi, set()).add(lo)
                above[lo] = hi
        every = set(t["lower"]) | set(t["higher"])
        out = []
        leaf = lambda v: len(up.get(v, ())) + len(down.get(v, ())) == 1
        queue = sorted(v for v in every if leaf(v))
        gone = set()

        def cut(v, kids, parent):
            """Take v out of a tree: its parent takes its children."""
            p = parent.pop(v, None)
            for k in kids.pop(v, ()):
                if p is None:
                    parent.pop(k, None)
                else:
                    parent[k] = p
                    kids[p].add(k)
            if p is not None:
                kids[p].discard(v)

        for v in queue:
            if v in gone or len(gone) >= len(every) - 1 or not leaf(v):
                continue
            top = not up.get(v)
            other = below[v] if top else above[v]
            out.append((t["cc"].iloc[0], other, v) if top else (t["cc"].iloc[0], v, other))
            gone.add(v)
            cut(v, up, below)
            cut(v, down, above)
            if other not in gone and leaf(other):
                queue.append(other)
        return pd.DataFrame(out, columns=["cc", "lower", "higher"])

    return both.groupBy("cc").applyInPandas(run, "cc long, lower long, higher long")


def critical_points(edges: DataFrame) -> DataFrame:
    """(idx, up, down, kind) of tree nodes: max without a higher one, min without a lower, saddle with several."""
    up = edges.groupBy(F.col("lower").alias("idx")).agg(F.count("*").alias("up"))
    down = edges.groupBy(F.col("higher").alias("idx")).agg(F.count("*").alias("down"))
    t = up.join(down, "idx", "full").fillna(0, ["up", "down"])
    kind = F.when(F.col("up") == 0, "max").when(F.col("down") == 0, "min").when((F.col("up") > 1) | (F.col("down") > 1), "saddle").otherwise("regular")
    return t.withColumn("kind", kind)


def critical_edges(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(lower, higher) between critical points: regular nodes of a tree are passed over, by pointer doubling."""
    edges = cut(edges)
    regular = critical_points(edges).where("kind = 'regular'").select(F.col("idx").alias("lower"))
    up = cut(edges.join(regular, "lower").select(F.col("lower").alias("node"), F.col("higher").alias("to")))
    for _ in range(rounds):
        further = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = cut(up.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        drop_cut(up)
        up = step.select("node", "to")
        up._cut_at = step._cut_at
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"chains are longer than {rounds} doublings")
    starts = edges.join(regular, "lower", "left_anti")
    out = starts.join(up.withColumnRenamed("node", "higher"), "higher", "left")
    return out.select("lower", F.coalesce("to", "higher").alias("higher"))


def maxima_and_saddles(edges: DataFrame) -> DataFrame:
    """Maxima (none higher) and merge saddles (several higher) of a compact join tree."""
    t = critical_points(edges)
    return t.where("up <> 1").select("idx", F.when(F.col("up") == 0, "max").otherwise("saddle").alias("kind"))


def branch_components(edges: DataFrame) -> DataFrame:
    """Nodes of a join tree by the maximum whose chain they continue: (label, component), by chain contraction."""
    edges = cut(edges)
    chain = edges.join(edges.groupBy("lower").count().where("count = 1").select("lower"), "lower", "left_semi")
    nodes = edges.select(F.col("lower").alias("label")).union(edges.select("higher")).distinct()
    return connected_components(nodes, chain.select(F.col("lower").alias("src"), F.col("higher").alias("dst")))


# ---------------------------------------------------------------- fast path over regions


def finest_regions(voxels: DataFrame, threshold: float, kind: str = "26", value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions of voxels at or above the threshold: by voxel (idx, region), by region (region, top, n), and the
    highest pass between two (a, b, saddle, beside).

    Voxels point to their steepest neighbour; pointers are followed to maxima, which name the regions, by
    doubling. A pass is the touching pair of voxels whose lower (then higher) value is largest. Only the
    region tables are needed for segmentations at any persistence.
    """
    v = voxels.where(F.col(value) >= threshold).select("idx", "x", "y", "z", F.col(value).alias("value"))
    pairs = cut(neighbor_pairs(v, offsets(kind), ("idx", "value"), {"o": "idx", "ov": "value"}).select("idx", "value", "o", "ov"))
    steep = pairs.groupBy("idx").agg(F.max(F.struct("ov", "o")).alias("best"))
    p = cut(v.join(steep, "idx", "left").select("idx", "value", F.when(F.col("best") > F.struct(F.col("value").alias("ov"), F.col("idx").alias("o")), F.col("best.o")).otherwise(F.col("idx")).alias("to")))
    for _ in range(64):
        hop = p.select(F.col("idx").alias("to"), F.col("to").alias("further"))
        q = cut(p.join(hop, "to").select("idx", "value", F.col("further").alias("to"), F.col("to").alias("was")))
        moved = not q.where("to <> was").isEmpty()
        drop_cut(p)
        p = q
        if not moved:
            break
    else:
        raise RuntimeError("ways to maxima are longer than 64 doublings")
    of = lambda n: p.select(F.col("idx").alias(n), F.col("to").alias(n + "_max"))
    passes = pairs.where("idx < o").join(of("idx"), "idx").join(of("o"), "o").where("idx_max <> o_max")
    height = F.max(F.struct(F.least("value", "ov").alias("saddle"), F.greatest("value", "ov").alias("beside"))).alias("pass")
    passes = passes.groupBy(F.least("idx_max", "o_max").alias("a"), F.greatest("idx_max", "o_max").alias("b")).agg(height).select("a", "b", "pass.*")
    tops = p.groupBy(F.col("to").alias("region")).agg(F.max("value").alias("top"), F.count("*").alias("n"))
    return p.select("idx", F.col("to").alias("region")), tops, passes


def _region_rows(tops: DataFrame, passes: DataFrame) -> DataFrame:
    own = tops.select(F.col("region").alias("a"), F.col("region").alias("b"), F.col("top").alias("saddle"), F.lit(0.0).alias("beside"), "n")
    return passes.select("a", "b", "saddle", "beside", F.lit(0).cast("long").alias("n")).unionByName(own)


def _passes_down(t: pd.DataFrame):
    """Regions' place, top and size, and passes (i, j, height) from the highest down."""
    own = t[t.a == t.b].sort_values("a")
    at = dict(zip(own.a, range(len(own))))
    p = t[t.a != t.b].sort_values(["saddle", "beside", "a", "b"], ascending=[False, False, True, True])
    return at, own.saddle.tolist(), own.n.tolist(), list(zip(p.a.map(at), p.b.map(at), p.saddle))


def region_merges(voxels: DataFrame, threshold: float, kind: str = "26", value: str = "value") -> DataFrame:
    """(persistence, size, lower_top, saddle): how long every region but the highest of a component lasts.

    The region tables (not voxels) are gathered in one task.
    """
    _, tops, passes = finest_regions(voxels, threshold, kind, value)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        at, top, n, down = _passes_down(t)
        s, out = Forest(len(at)), []
        for i, j, h in down:
            i, j = s.find(i), s.find(j)
            if i != j:
                if (top[i], n[i]) < (top[j], n[j]):
                    i, j = j, i
                out.append((top[j] - h, n[j], top[j], h))
                best, size = top[i], n[i] + n[j]
                k = s.union(i, j)
                top[k], n[k] = best, size
        out += [(float("inf"), n[i], top[i], float("-inf")) for i in range(len(at)) if s.find(i) == i]
        return pd.DataFrame(out, columns=["persistence", "size", "top", "saddle"])

    return _region_rows(tops, passes).groupBy().applyInPandas(run, "persistence double, size long, top double, saddle double")


def segment_regions(regions: DataFrame, tops: DataFrame, passes: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(idx, label) of voxels in ``finest_regions`` after merges by the rule, from the highest pass down.

    For another rule only this is done again, on the region tables (gathered in one task). A region
    counts with all its voxels, so with a minimum size the result differs from ``segment``; without one it
    is that of ``segment`` in order of value. An adaptive rule needs its ``floor``.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        at, top, n, down = _passes_down(t)
        s = Forest(len(at))
        for i, j, h in down:
            i, j = s.find(i), s.find(j)
            if i != j and rule.merges(top[i], n[i], top[j], n[j], h):
                best, size = max(top[i], top[j]), n[i] + n[j]
                k = s.union(i, j)
                top[k], n[k] = best, size
        names = list(at)
        return pd.DataFrame({"region": names, "component": [names[s.find(i)] for i in range(len(names))]}, columns=["region", "component"])

    merged = _region_rows(tops, passes).groupBy().applyInPandas(run, "region long, component long")
    named = cut(regions.join(cut(merged), "region").select("idx", "component"))
    return named.join(first_seen_mapping(named), "component").select("idx", "label")


def segment_fast(voxels: DataFrame, threshold: float, rule: Rule = Rule(), kind: str = "26", value: str = "value") -> DataFrame:
    """(idx, label) of every voxel by the region graph, 0 under the threshold; no voxel goes through a single task."""
    if rule.mode == "adaptive":
        rule = replace(rule, floor=float(voxels.agg(F.min(value)).first()[0] or 0.0))
    named = segment_regions(*finest_regions(voxels, threshold, kind, value), rule)
    return voxels.select("idx").join(named, "idx", "left").fillna(0, ["label"])


def persistence_plot(merges: DataFrame, highest: float, samples: int = 200, ties: bool = False) -> DataFrame:
    """(persistence, segments) at evenly spaced persistences from 0: regions that last longer, or as long with ``ties``."""
    spark = merges.sparkSession
    s = spark.range(samples).select((F.col("id") * F.lit(highest / (samples - 1))).alias("p"))
    curve = s.withColumn("at", F.lit(not ties)).unionByName(merges.select(F.col("persistence").alias("p"), F.lit(ties).alias("at")))
    w = Window.partitionBy().orderBy(F.col("p").desc(), F.col("at").desc())  # samples and one row per region
    return curve.withColumn("segments", F.count_if(F.col("at") == ties).over(w)).where(F.col("at") != ties).select(F.col("p").alias("persistence"), "segments")


def merge_events(voxels: DataFrame, threshold: float, rule: Rule = Rule(), kind: int = 26, value: str = "value") -> DataFrame:
    """(persistence): how long each region of the sweep lasts, infinite for the last one of a component.

    Where regions meet at a voxel, all but the largest that are smaller than ``rule.min_size`` merge whatever the
    persistence, and are no row; of the others all but the highest last from their top down to the voxel.
    The voxel counts for the first region beside it. Adaptive: as a share of the height above the minimum.
    """
    if rule.mode == "adaptive":
        rule = replace(rule, floor=float(voxels.agg(F.min(value)).first()[0] or 0.0))
    parts = superlevel_components(voxels, threshold, "26", value).select("cc", "idx", "x", "y", "z", F.col(value).alias("value"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        g = Grid(t, kind)
        s, top, out = Forest(len(g.idx)), g.value.copy(), []
        for i, at in enumerate(g.value):
            found = _ranked(g.earlier(i), g, s, rule.order)
            beside = list(dict.fromkeys(s.find(j) for j in found))
            meet = sorted((s.size[c] + (k == 0), top[c]) for k, c in enumerate(beside))
            merged = sum(n < rule.min_size for n, _ in meet[:-1])
            by_height = sorted((high, k < len(meet) - 1 and n < rule.min_size) for k, (n, high) in enumerate(meet))
            for high, by_size in by_height[:-1]:
                if not by_size and merged < len(meet) - 1:
                    merged += 1
                    out.append((high - at) / (high - rule.floor) if rule.mode == "adaptive" else high - at)
            for c in beside:
                best = max(top[s.find(i)], top[s.find(c)])
                top[s.union(i, c)] = best
        return pd.DataFrame({"persistence": [*out, float("inf")]})

    return parts.groupBy("cc").applyInPandas(run, "persistence double")


def persistence_sweep(voxels: DataFrame, threshold: float, first: float, last: float, step: float, kind: int = 26, value: str = "value", **rule) -> DataFrame:
    """(persistence, idx, label) for every persistence from first to last, the last included.

    Components are found once; a component's voxels are ordered once for all persistences.
    """
    steps = [first + k * step for k in range(int(round((last - first) / step)) + 1)]
    base = Rule(**rule)
    if base.mode == "adaptive":
        base = replace(base, floor=float(voxels.agg(F.min(value)).first()[0] or 0.0))
    parts = superlevel_components(voxels, threshold, "26", value).select("cc", "idx", "x", "y", "z", F.col(value).alias("value"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        g, out = Grid(t, kind), []
        for p in steps:
            s = sweep(g, replace(base, persistence=p))
            out.append(pd.DataFrame({"persistence": p, "idx": g.idx, "component": [int(g.idx[s.find(i)]) for i in range(len(g.idx))]}))
        return pd.concat(out)

    regions = cut(parts.groupBy("cc").applyInPandas(run, "persistence double, idx long, component long"))
    named = regions.join(first_seen_mapping(regions, by=("persistence",)), ["persistence", "component"]).select("persistence", "idx", "label")
    every = voxels.select("idx").withColumn("persistence", F.explode(F.array(*[F.lit(p) for p in steps])))
    return every.join(named, ["persistence", "idx"], "left").fillna(0, ["label"])


# ---------------------------------------------------------------- splits of one label


def _split_two(g: Grid) -> list[int]:
    """Region of each voxel when the merge is vetoed whose two sides are the most alike in size."""

    def replay(veto: int):
        s, seen, kept = Forest(len(g.idx)), 0, None
        for i in range(len(g.idx)):
            for rank, j in enumerate(_ranked(g.earlier(i), g, s, "majority")):
                a, b = s.find(i), s.find(j)
                if a == b:
                    continue
                seen += rank > 0
                if kept is not None:
                    held = {s.find(kept[0]), s.find(kept[1])}
                    if a in held and b in held:
                        continue
                elif rank > 0 and seen == veto:
                    kept = (i, j)
                    continue
                s.union(a, b)
        if kept is None:
            return None
        a, b = s.find(kept[0]), s.find(kept[1])
        return abs(s.size[a] - s.size[b]), s

    best, veto = None, 1
    while (r := replay(veto)) is not None:
        if best is None or r[0] < best[0]:
            best = r
        veto += 1
    if best is None:
        return [0] * len(g.idx)
    first = best[1].find(0)
    return [0 if best[1].find(i) == first else 1 for i in range(len(g.idx))]


def _split_standard(g: Grid, persistence: float) -> list[int]:
    s = sweep(g, Rule(persistence=persistence, order="majority"))
    names: dict[int, int] = {}
    return [names.setdefault(s.find(i), len(names)) for i in range(len(g.idx))]


def _split_spectral(g: Grid, k: int) -> list[int]:
    """k-means, from spread-out starts, on the lowest eigenvectors of the neighbourhood graph's Laplacian."""
    n = len(g.idx)
    a = np.zeros((n, n))
    i, j = np.nonzero(g.near >= 0)
    a[i, g.near[i, j]] = 1
    _, vec = np.linalg.eigh(np.diag(a.sum(1)) - a)
    p = vec[:, :k]
    centers = [p[0]]
    for _ in range(k - 1):
        centers.append(p[np.argmax(np.min([((p - c) ** 2).sum(1) for c in centers], 0))])
    c = np.array(centers)
    for _ in range(100):
        near = ((p[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([p[near == m].mean(0) if (near == m).any() else c[m] for m in range(k)])
        if np.allclose(new, c):
            break
        c = new
    names: dict[int, int] = {}
    return [names.setdefault(int(m), len(names)) for m in near]


def split_label(voxels: DataFrame, label: int, how: str = "two", distance: str = "distance", least: float = 1e-6, persistence: float = 0.0, parts: int = 2, column: str = "label") -> DataFrame:
    """(idx, label) of one label's voxels after a split: 'two', 'standard' or 'spectral'.

    The part of the highest voxel keeps the label, others follow the largest label. Voxels whose
    distance is not above ``least`` stay as they are. One label is one task's work.
    """
    last = voxels.agg(F.max(column)).first()[0]
    own = voxels.where((F.col(column) == label) & (F.col(distance) > least)).select("idx", "x", "y", "z", F.col(distance).alias("value"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        g = Grid(t, 26)
        part = _split_two(g) if how == "two" else _split_standard(g, persistence) if how == "standard" else _split_spectral(g, parts)
        return pd.DataFrame({"idx": g.idx, "label": [label if p == 0 else last + p for p in part]})

    changed = own.groupBy().applyInPandas(run, "idx long, label long")
    rest = voxels.where((F.col(column) == label) & ~(F.col(distance) > least)).select("idx", F.lit(label).cast("long").alias("label"))
    return changed.unionByName(rest)

"""Region adjacency graphs, contacts, components, selections of critical regions, and edits.

An edit is a mapping (label, target) of region size; voxels and edges follow it by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.lattice import forward, neighbor_pairs
from latticework.sources.staging import cut, drop_cut


def adjacency(voxels: DataFrame, label: str = "label", kind: str = "corners26", skip_first_planes: bool = True) -> DataFrame:
    """Edges (src < dst) between labels that touch.

    ``kind``: '6', '18', '26', or 'corners26' (faces and corners only). With ``skip_first_planes`` a
    neighbour counts only if all its indices are above 0.
    """
    fore = voxels.where(F.col(label) > 0)
    pairs = neighbor_pairs(fore, forward(kind), (label,), {"_l": label}).where(F.col(label) != F.col("_l"))
    if skip_first_planes:
        pairs = pairs.where("nx > 0 and ny > 0 and nz > 0")
    return pairs.select(F.least(label, "_l").alias("src"), F.greatest(label, "_l").alias("dst")).distinct()


def touched_adjacency(voxels: DataFrame, labels: DataFrame, distance: str, least: float, label: str = "label") -> DataFrame:
    """Edges of the labels that a split touched, rebuilt from all 26 neighbours with a distance above least."""
    e = adjacency(voxels.where(F.col(distance) > least), label, "26", False)
    t = labels.select(F.col("label").alias("_t"))
    own = lambda end: e.join(t, F.col(end) == F.col("_t"), "left_semi")
    return own("src").union(own("dst")).distinct()


def connecting_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (label, other) with whether an edge connects them, in either direction."""
    e = edges.select("src", "dst", F.lit(True).alias("connected")).distinct()
    lo, hi = F.least("label", "other"), F.greatest("label", "other")
    return pairs.join(e, (lo == F.col("src")) & (hi == F.col("dst")), "left").select("label", "other", F.coalesce("connected", F.lit(False)).alias("connected"))


def contacts(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Face contacts between different labels, background included: (src < dst, faces)."""
    pairs = neighbor_pairs(voxels, forward("6"), (label,), {"_l": label}).where(F.col(label) != F.col("_l"))
    return pairs.groupBy(F.least(label, "_l").alias("src"), F.greatest(label, "_l").alias("dst")).agg(F.count("*").alias("faces"))


def patch_material(contact: DataFrame) -> DataFrame:
    """The inner label of patches that touch the exterior, else -1."""
    return contact.withColumn("material", F.when(F.col("src") == 0, F.col("dst")).otherwise(-1))


def vertices(stats: DataFrame) -> DataFrame:
    """Label stats numbered from 0 by label: the graph's vertices."""
    return stats.withColumn("vertex_id", F.row_number().over(Window.orderBy("label")) - 1)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("label"), F.col("dst").alias("other")).union(edges.select("dst", "src"))


def edge_lengths(edges: DataFrame, stats: DataFrame) -> DataFrame:
    end = lambda p: stats.select(F.col("label").alias(p), *[F.col("c" + c).alias(p + c) for c in "xyz"])
    e = edges.join(end("src"), "src").join(end("dst"), "dst")
    d = sum((F.pow(F.col("src" + c) - F.col("dst" + c), 2) for c in "xyz"), F.lit(0.0))
    return e.select("src", "dst", F.sqrt(d).alias("length"))


def critical_small(stats: DataFrame, below: int) -> DataFrame:
    return stats.where(F.col("n") < below).select("label")


def critical_near(edges: DataFrame, stats: DataFrame, below: float) -> DataFrame:
    near = edge_lengths(edges, stats).where(F.col("length") < below)
    return near.select(F.explode(F.array("src", "dst")).alias("label")).distinct()


def critical_inside(stats: DataFrame, contact: DataFrame) -> DataFrame:
    """Labels that have no contact with the background."""
    outer = contact.where("src = 0").select(F.col("dst").alias("label"))
    return stats.select("label").join(outer, "label", "left_anti")


def critical_exterior_only(stats: DataFrame, contact: DataFrame) -> DataFrame:
    """Labels that have no contact with another label."""
    inner = both_ways(contact.where("src > 0")).select("label").distinct()
    return stats.select("label").join(inner, "label", "left_anti")


def degrees(stats: DataFrame, edges: DataFrame) -> DataFrame:
    d = both_ways(edges).groupBy("label").agg(F.count("*").alias("degree"))
    return stats.select("label").join(d, "label", "left").fillna(0, ["degree"])


def critical_degree(stats: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """Fewer neighbours than least or more than most."""
    return degrees(stats, edges).where((F.col("degree") > most) | (F.col("degree") < least)).select("label")


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(label) and edges (src, dst) to (label, component = smallest label reachable).

    In every round each component hooks onto the least one beside it, pointers are followed four
    steps, and edges shrink to those between different components; so components at least halve.
    Each round is written to the shared folder.
    """
    e = cut(both_ways(edges).where("label <> other").distinct())
    c = nodes.select("label", F.col("label").alias("component")).distinct()
    for _ in range(rounds):
        if e.isEmpty():
            break
        hook = e.groupBy("label").agg(F.min("other").alias("up")).select("label", F.least("label", "up").alias("up"))
        for _ in range(2):
            hook, last = cut(hook), hook
            drop_cut(last)
            further = hook.select(F.col("label").alias("up"), F.col("up").alias("next"))
            hook = hook.join(further, "up", "left").select("label", F.coalesce("next", "up").alias("up"))
        hook = cut(hook)
        to = lambda n: hook.select(F.col("label").alias(n), F.col("up").alias(n + "_up"))  # noqa: E731,B023
        c, last = cut(c.join(to("component"), "component", "left").select("label", F.coalesce("component_up", "component").alias("component"))), c
        drop_cut(last)
        last = e
        e = e.join(to("label"), "label").join(to("other"), "other").select(F.col("label_up").alias("label"), F.col("other_up").alias("other"))
        e = cut(e.where("label <> other").distinct())
        drop_cut(last, hook)
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return c


def critical_component_size(stats: DataFrame, edges: DataFrame, below: int) -> DataFrame:
    c = connected_components(stats.select("label"), edges)
    small = c.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") < below)
    return c.join(small, "component", "left_semi").select("label")


def buffer_add(buffer: DataFrame, more: DataFrame) -> DataFrame:
    return buffer.select("label").union(more.select("label")).distinct()


def buffer_remove(buffer: DataFrame, less: DataFrame) -> DataFrame:
    return buffer.select("label").distinct().join(less, "label", "left_anti")


def largest_neighbor(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, target): the neighbour with most voxels, the smaller label on ties, 0 for isolated regions."""
    size = stats.select(F.col("label").alias("other"), "n")
    best = both_ways(edges).join(size, "other").groupBy("label").agg(F.max_by("other", F.struct("n", -F.col("other"))).alias("target"))
    return stats.select("label").join(best, "label", "left").fillna(0, ["target"])


def meld(mapping: DataFrame, stats: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stats and edges after a mapping; edges lose loops, doubles and ends in 0."""
    from latticework.operators.labels import merged_centroids

    to = lambda c: mapping.select(F.col("label").alias(c), F.col("target").alias(c + "_to"))
    e = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    a, b = F.coalesce("src_to", "src"), F.coalesce("dst_to", "dst")
    e = e.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src <> dst and src > 0").distinct()
    return merged_centroids(stats, mapping), e


def meld_chain(labels: list[int], spark) -> DataFrame:
    """All labels of a chain go to its last one."""
    return spark.createDataFrame([(x, labels[-1]) for x in labels[:-1]], "label int, target int")


def removal(labels: DataFrame) -> DataFrame:
    return labels.select("label", F.lit(0).alias("target"))


def meld_critical(critical: DataFrame, stats: DataFrame, edges: DataFrame) -> DataFrame:
    """Mapping that melds critical regions one after another into their then largest neighbour.

    The order matters, as sizes grow; so the region tables (not voxels) are gathered in one task.
    """
    import pandas as pd

    nodes = stats.join(critical.withColumn("hit", F.lit(True)), "label", "left").select(F.lit("n").alias("kind"), F.col("label").cast("long").alias("a"), F.col("n").cast("long").alias("b"), F.coalesce("hit", F.lit(False)).alias("hit"))
    rows = nodes.unionByName(edges.select(F.lit("e").alias("kind"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.lit(False).alias("hit")))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        n, e = t[t.kind == "n"], t[t.kind == "e"]
        size = dict(zip(n.a, n.b))
        near: dict[int, set] = {x: set() for x in size}
        for a, b in zip(e.a, e.b):
            near[a].add(b)
            near[b].add(a)
        target = {}
        for x in sorted(n.a[n.hit]):
            to = max(near[x], key=lambda y: (size[y], -y), default=0)
            target[x] = to
            for y in near.pop(x):
                near[y].discard(x)
                if to and y != to:
                    near[y].add(to)
                    near[to].add(y)
            if to:
                size[to] += size[x]

        def last(x):
            while x in target:
                x = target[x]
            return x

        return pd.DataFrame({"label": list(target), "target": [last(x) for x in target]}, columns=["label", "target"])

    return rows.groupBy().applyInPandas(run, "label long, target long")


def unsupported(voxels: DataFrame, label: str, reference: str) -> DataFrame:
    """Labels whose voxels are all 0 in a reference field."""
    return voxels.where(F.col(label) > 0).groupBy(F.col(label).alias("label")).agg(F.max((F.col(reference) != 0).cast("int")).alias("some")).where("some = 0").select("label")


def threshold_selected(voxels: DataFrame, selected: DataFrame, value: str, below: float, label: str = "label") -> DataFrame:
    """Voxels of selected labels under a value become background."""
    s = selected.select(F.col("label").alias("_s"))
    t = voxels.join(s, voxels[label] == F.col("_s"), "left")
    return t.withColumn(label, F.when(F.col("_s").isNotNull() & (F.col(value) < below), 0).otherwise(F.col(label))).drop("_s")


def color_regions(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, color): no two neighbours share a color; the first free one is taken in order of label.

    The region tables (not voxels) are gathered in one task.
    """
    import pandas as pd

    rows = stats.select(F.col("label").cast("long").alias("a"), F.col("label").cast("long").alias("b")).union(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        near = _near(zip(t.a, t.b))
        color: dict[int, int] = {}
        for x in sorted(near):
            used = {color[y] for y in near[x] if y in color}
            color[x] = next(c for c in range(len(used) + 1) if c not in used)
        return pd.DataFrame({"label": list(color), "color": list(color.values())}, columns=["label", "color"])

    return rows.groupBy().applyInPandas(run, "label long, color int")


def _near(pairs) -> dict[int, set]:
    near: dict[int, set] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def palette(levels: int = 5) -> list[tuple[float, float, float]]:
    """Colours at even steps of red, green and blue."""
    step = [i / (levels - 1) for i in range(levels)]
    return [(r, g, b) for r in step for g in step for b in step]


def improve_colors(colors: DataFrame, edges: DataFrame, least: float = 0.5, levels: int = 5) -> DataFrame:
    """(label, r, g, b) after every edge, in order, whose ends differ by less than ``least`` has given its second
    end the first colour of the palette that differs by so much from all neighbours; if none does, it stays.

    The order matters, so the region tables (not voxels) are gathered in one task.
    """
    import pandas as pd

    zero = [F.lit(0.0)] * 3
    rows = colors.select(F.col("label").cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), *[F.col(c).cast("double") for c in "rgb"])
    rows = rows.union(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *zero))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        own, pairs = t[t.dst.isna()], sorted(zip(*(t[t.dst.notna()][c].astype("int64") for c in ("src", "dst"))))
        color = dict(zip(own.src, zip(own.r, own.g, own.b)))
        near, free = _near(pairs), palette(levels)
        far = lambda p, q: sum((x - y) * (x - y) for x, y in zip(p, q)) >= least * least
        for a, b in pairs:
            if not far(color[a], color[b]):
                color[b] = next((c for c in free if all(far(c, color[y]) for y in near[b] if y != b)), color[b])
        return pd.DataFrame([(k, *v) for k, v in sorted(color.items())], columns=["label", "r", "g", "b"])

    return rows.groupBy().applyInPandas(run, "label long, r double, g double, b double")


def exterior_field(contact: DataFrame, values: DataFrame) -> DataFrame:
    """A value for every patch: the inner region's where it touches the exterior, else 0."""
    m = patch_material(contact).join(values.select(F.col("label").alias("material"), "value"), "material", "left")
    return m.select("src", "dst", F.coalesce("value", F.lit(0.0)).alias("value"))

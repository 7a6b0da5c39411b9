"""Partition and landmark metrics: contingency, Dice, variation of information, Rand, landmark tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.sources.volumes import Geometry


def contingency(voxels: DataFrame, seg: str, gt: str, keep: Column, *by: str) -> DataFrame:
    """Counts of label pairs where keep holds: (by..., i, j, n). Partial counts precede the shuffle."""
    return voxels.where(keep).groupBy(*by, F.col(seg).alias("i"), F.col(gt).alias("j")).agg(F.count("*").alias("n"))


def _with_marginals(table: DataFrame, *by: str) -> DataFrame:
    """One pass of grouping sets over a region-sized table."""
    g = table.cube("i", "j") if not by else table.groupingSets([[*by, "i", "j"], [*by, "i"], [*by, "j"], [*by]], *by, "i", "j")
    return g.agg(F.sum("n").alias("n"), F.grouping("i").alias("gi"), F.grouping("j").alias("gj"))


def dice(voxels: DataFrame, seg: str, gt: str, mask: str = "mask") -> DataFrame:
    """2 |S & G| / (|S| + |G|) of the foregrounds where mask <> 0; null where both are empty."""
    s, g = F.col(seg) > 0, F.col(gt) > 0
    total = lambda c: F.count_if(c)
    return voxels.where(F.col(mask) != 0).agg(F.try_divide(2.0 * total(s & g), total(s) + total(g)).alias("dice"))


def variation_of_information(table: DataFrame, *by: str) -> DataFrame:
    """From (by..., i, j, n): the sum of r (ln(p/r) + ln(q/r)) over label pairs, background included."""
    t = table
    for name, keys in (("ni", [*by, "i"]), ("nj", [*by, "j"]), ("total", [*by])):
        sums = table.groupBy(*keys).agg(F.sum("n").alias(name))
        t = t.join(sums, keys) if keys else t.crossJoin(F.broadcast(sums))  # one row
    r = F.col("n") / F.col("total")
    return t.groupBy(*by).agg(F.sum(r * (F.ln(F.col("ni") / F.col("n")) + F.ln(F.col("nj") / F.col("n")))).alias("vi"))


def rand_index(table: DataFrame, *by: str) -> DataFrame:
    """Closed form over the contingency table; no pair of voxels is formed. Null for under two voxels."""
    m = _with_marginals(table, *by)
    kind = lambda gi, gj: (F.col("gi") == gi) & (F.col("gj") == gj)
    only = lambda gi, gj: F.coalesce(F.sum(F.when(kind(gi, gj), (F.col("n") * (F.col("n") - 1)).cast("double"))), F.lit(0.0))
    s, r, c, t = only(0, 0), only(0, 1), only(1, 0), only(1, 1)
    return m.groupBy(*by).agg(F.try_divide(t - r - c + 2 * s, t).alias("rand_index"))


def compare_all(labels: DataFrame, keep: Column | None = None) -> DataFrame:
    """(method, idx, label) to VI and Rand index of every pair of methods."""
    one = labels if keep is None else labels.where(keep)
    a = one.select(F.col("method").alias("m1"), "idx", F.col("label").alias("i"))
    b = one.select(F.col("method").alias("m2"), "idx", F.col("label").alias("j"))
    table = a.join(b, "idx").where("m1 < m2").groupBy("m1", "m2", "i", "j").agg(F.count("*").alias("n"))
    return variation_of_information(table, "m1", "m2").join(rand_index(table, "m1", "m2"), ["m1", "m2"])


# ---------------------------------------------------------------- landmarks


def landmark_labels(landmarks: DataFrame, voxels: DataFrame, g: Geometry, label: str = "label") -> DataFrame:
    """(landmark_id, x, y, z) to (landmark_id, label) by the nearest voxel.

    A background voxel gives way to the voxels around the half-shifted position: if those hold just
    one positive label, it is taken; none or several give 0. At most nine candidates per landmark
    meet the volume in one equi-join.
    """
    frac = [((F.col(c) - F.lit(o) + F.lit(0.5 * v)) / F.lit(v)) for c, o, v in zip("xyz", g.origin, g.voxel)]
    t = landmarks.select("landmark_id", *[f.alias("f" + c) for f, c in zip(frac, "xyz")])
    near = F.struct(*[F.col("f" + c).cast("int").alias(c) for c in "xyz"], F.lit(True).alias("nearest"))
    corner = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    pick = lambda c, up: (F.ceil("f" + c) if up else F.floor("f" + c)).cast("int").alias(c)
    corners = [F.struct(pick("x", a), pick("y", b), pick("z", c), F.lit(False).alias("nearest")) for a, b, c in corner]
    e = t.select("landmark_id", F.explode(F.array_distinct(F.array(near, *corners))).alias("p")).select("landmark_id", "p.*")
    found = e.join(voxels.select("x", "y", "z", F.col(label).alias("_l")), ["x", "y", "z"])
    g1 = found.groupBy("landmark_id").agg(F.max(F.when(F.col("nearest"), F.col("_l"))).alias("own"), F.collect_set(F.when(~F.col("nearest") & (F.col("_l") > 0), F.col("_l"))).alias("around"))
    pick_label = F.when(F.col("own") > 0, F.col("own")).when(F.size("around") == 1, F.element_at("around", 1)).otherwise(0)
    return landmarks.select("landmark_id").join(g1, "landmark_id", "left").select("landmark_id", F.coalesce(pick_label, F.lit(0)).alias("label"))


def landmark_labels_search(landmarks: DataFrame, voxels: DataFrame, g: Geometry, label: str = "label", wrap: bool = True) -> DataFrame:
    """(landmark_id, label) of the first foreground voxel that a breadth-first search meets.

    The search runs over linear indices, in the order +x, -x, +y, -y, +z, -z; with ``wrap`` it goes on
    across row and slice ends, as a plain index step does. The foreground reaches tasks by grouping each
    volume with its landmarks.
    """
    n, (nx, ny, _) = g.size, g.dims
    steps = (1, -1, nx, -nx, nx * ny, -nx * ny)
    at = [F.floor((F.col(c) - F.lit(o) + F.lit(0.5 * v)) / F.lit(v)).cast("long") for c, o, v in zip("xyz", g.origin, g.voxel)]
    seeds = landmarks.select("landmark_id", ((at[2] * ny + at[1]) * nx + at[0]).alias("idx"))
    field = voxels.where(F.col(label) > 0).select("idx", F.col(label).cast("int").alias("label"))

    def search(own: pd.DataFrame, fore: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(fore["idx"], fore["label"]))
        out = []
        for lid, seed in zip(own["landmark_id"], own["idx"]):
            queue, seen, hit = [int(seed)] if 0 <= seed < n else [], {int(seed)}, 0
            for i in queue if known else []:
                if i in known:
                    hit = known[i]
                    break
                for k, s in enumerate(steps):
                    j = i + s
                    if not 0 <= j < n or j in seen:
                        continue
                    if not wrap and (k < 2 and j // nx != i // nx or 2 <= k < 4 and j // (nx * ny) != i // (nx * ny)):
                        continue
                    seen.add(j)
                    queue.append(j)
            out.append((lid, hit))
        return pd.DataFrame(out, columns=["landmark_id", "label"])

    one = lambda df: df.withColumn("volume", F.lit(0)).groupBy("volume")
    return one(seeds).cogroup(one(field)).applyInPandas(search, "landmark_id long, label int")


def landmark_table(hits: DataFrame, last_label: int) -> DataFrame:
    """A row per label 0..last_label: hits, correct (1), over-segmented (0), clusters of 2 to 5."""
    spark = hits.sparkSession
    counts = hits.groupBy("label").agg(F.count("*").alias("hits"))
    t = spark.range(last_label + 1).select(F.col("id").alias("label")).join(counts, "label", "left").fillna(0, ["hits"])
    flag = lambda n: ((F.col("label") > 0) & (F.col("hits") == n)).cast("int")
    return t.select("label", "hits", flag(1).alias("correct"), flag(0).alias("oversegmented"), *[flag(n).alias(f"cluster{n}") for n in range(2, 6)])


def landmark_summary(table: DataFrame, *by: str) -> DataFrame:
    """Counts over labels above 0, background hits, precision and recall."""
    fore = F.col("label") > 0
    total = lambda c: F.coalesce(F.sum(F.when(fore, c)), F.lit(0))
    t = table.groupBy(*by).agg(
        total((F.col("hits") == 1).cast("long")).alias("correct"), total((F.col("hits") > 1).cast("long")).alias("clusters"),
        total(F.when(F.col("hits") > 1, F.col("hits") - 1).otherwise(0)).alias("weighted"), total((F.col("hits") == 0).cast("long")).alias("oversegmented"),
        F.coalesce(F.sum(F.when(~fore, F.col("hits"))), F.lit(0)).alias("background"),
    )
    tp = F.col("correct") + F.col("clusters")
    return t.withColumns({"precision": F.try_divide(tp.cast("double"), tp + F.col("oversegmented")), "recall": F.try_divide(tp.cast("double"), tp + F.col("weighted") + F.col("background"))})


def landmark_sides(hits: DataFrame) -> DataFrame:
    """Background landmarks, and for labels with 2 to 5 hits the last landmark: (kind, label, landmark_id)."""
    back = hits.where("label = 0").select(F.lit("background").alias("kind"), "label", "landmark_id")
    many = hits.where("label > 0").groupBy("label").agg(F.count("*").alias("n"), F.max("landmark_id").alias("landmark_id")).where("n between 2 and 5")
    return back.unionByName(many.select(F.concat(F.lit("cluster"), F.col("n").cast("string")).alias("kind"), "label", "landmark_id"))

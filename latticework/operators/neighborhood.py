"""Box means by separable running sums; dilation and means around labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.lattice import with_neighbors

XYZ = ("x", "y", "z")


def box_mean(voxels: DataFrame, size: int, label: str = "label", value: str = "value") -> DataFrame:
    """(idx, mean) of the foreground values in the cube of +-size around every foreground voxel; 0 for background.

    The cube's sums are sums along x, then y, then z, each a window over one line of the dense grid.
    """
    fore = F.col(label) > 0
    v = voxels.select("idx", "x", "y", "z", fore.alias("fore"), fore.cast("long").alias("n"), F.when(fore, F.col(value)).otherwise(0.0).alias("s"))
    for axis, others in (("x", ("y", "z")), ("y", ("x", "z")), ("z", ("x", "y"))):
        w = Window.partitionBy(*others).orderBy(axis).rangeBetween(-size, size)
        v = v.withColumns({"n": F.sum("n").over(w), "s": F.sum("s").over(w)})
    return v.select("idx", F.when(F.col("fore"), F.try_divide(F.col("s"), F.col("n"))).otherwise(0.0).alias("mean"))


def ball(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(a, b, c) for a in r for b in r for c in r if a * a + b * b + c * c <= radius * radius]


def dilation_ring(voxels: DataFrame, radius: int, label: str = "label") -> DataFrame:
    """(label, idx): background voxels within a ball of each label.

    The label's voxel nearest to a background voxel has another value on the face towards it, so only
    voxels with such a face are sent out by the ball.
    """
    fore = voxels.where(F.col(label) > 0).select("x", "y", "z", F.col(label).alias("label"), *[F.col(c).alias("o" + c) for c in XYZ])
    place = [F.col(c).alias("n" + c) for c in XYZ]
    faces = [o for o in ball(1) if any(o)]
    beside = with_neighbors(fore, faces, "label", "ox", "oy", "oz").join(voxels.select(*place, F.col(label).alias("_other")), ["nx", "ny", "nz"])
    surface = beside.where(F.col("_other") != F.col("label")).select("label", *[F.col("o" + c).alias(c) for c in XYZ]).distinct()
    back = voxels.where(F.col(label) == 0).select(*place, "idx")
    return with_neighbors(surface, ball(radius), "label").join(back, ["nx", "ny", "nz"]).select("label", "idx").distinct()


def mean_around_labels(voxels: DataFrame, radius: int, last_label: int, label: str = "label", value: str = "value") -> DataFrame:
    """For labels 1..last: (label, inside_mean, n, mean) of the ring's voxels above the label's own mean; 0 if none."""
    inside = voxels.where(F.col(label) > 0).groupBy(F.col(label).alias("label")).agg(F.avg(value).alias("inside_mean"))
    ring = dilation_ring(voxels, radius, label).join(voxels.select("idx", F.col(value).alias("v")), "idx").join(inside, "label").where(F.col("v") > F.col("inside_mean"))
    around = ring.groupBy("label").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    every = voxels.sparkSession.range(1, last_label + 1).select(F.col("id").cast("int").alias("label"))
    return every.join(inside, "label", "left").join(around, "label", "left").fillna(0, ["n"]).fillna(0.0, ["inside_mean", "mean"])

"""Label fields: ranges, histograms, sizes, centroids, renumbering, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.sources.staging import cut
from latticework.sources.volumes import Geometry


def field_range(voxels: DataFrame, value: str = "value") -> DataFrame:
    return voxels.agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def histogram(voxels: DataFrame, value: str = "value", bins: int = 256) -> DataFrame:
    """(bin from 0, n) for every bin of equal width between minimum and maximum; the maximum is in the last."""
    r = field_range(voxels, value)
    b = F.when(F.col("vmax") > F.col("vmin"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("vmin")) / (F.col("vmax") - F.col("vmin")) * bins))).otherwise(0)
    counts = voxels.crossJoin(F.broadcast(r)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # r is one row
    every = voxels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["n"])


def robust_range(voxels: DataFrame, value: str = "value", low: float = 0.05, high: float = 0.95, bins: int = 256) -> DataFrame:
    """Range between two shares of the voxels, as lower edges of histogram bins; (0, 1) is the full range."""
    r = field_range(voxels, value)
    if (low, high) == (0.0, 1.0):
        return r
    h = histogram(voxels, value, bins)
    upto = F.sum("n").over(Window.partitionBy().orderBy("bin"))  # one row per bin
    c = h.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    total = h.agg(F.sum("n").alias("total"))
    c = c.crossJoin(F.broadcast(total)).withColumns({"lo": F.bround(F.col("total") * low), "hi": F.bround(F.col("total") * high)})
    # the first bin past the lower count ends the scan; so does, from above, the first with too few before it
    i = c.agg(F.max(F.when(F.col("upto") <= F.col("lo"), F.col("bin"))).alias("imin"), F.max(F.when(F.col("before") < F.col("hi"), F.col("bin"))).alias("stop"))
    edge = lambda k: F.col("vmin") + (F.col("vmax") - F.col("vmin")) / bins * k
    return r.crossJoin(F.broadcast(i)).select(edge(F.coalesce("imin", F.lit(0))).alias("vmin"), edge(F.least(F.lit(bins - 1), F.coalesce(F.col("stop") + 1, F.lit(0)))).alias("vmax"))


def default_parameters(voxels: DataFrame, value: str = "value", relative: bool = False) -> DataFrame:
    """Threshold, persistence and minimum size that a segmentation begins with."""
    r = field_range(voxels, value)
    width = F.lit(1.0) if relative else F.col("vmax") - F.col("vmin")
    return r.select(((F.col("vmin") + F.col("vmax")) / 2).alias("threshold"), (0.05 * width).alias("persistence"), F.lit(50).alias("min_size"))


def label_sizes(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def label_stats(voxels: DataFrame, g: Geometry, label: str = "label", only: Column | None = None) -> DataFrame:
    """(label, n, cx, cy, cz): size and centroid of every label but 0, or of those that ``only`` picks."""
    v = voxels.where(F.col(label) > 0)
    v = v if only is None else v.where(only)
    v = v.select(F.col(label).alias("label"), *g.position())
    return v.groupBy("label").agg(F.count("*").alias("n"), *[F.avg("p" + c).alias("c" + c) for c in "xyz"])


def label_mean(voxels: DataFrame, label: str, value: str) -> DataFrame:
    return voxels.where(F.col(label) > 0).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def merged_centroids(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Stats after a mapping (label, target): sizes add up, centroids by weight; unmapped labels stay, target 0 goes."""
    to = stats.join(mapping, "label", "left").withColumn("label", F.coalesce("target", "label")).where("label > 0")
    w = lambda c: (F.sum(F.col("c" + c) * F.col("n")) / F.sum("n")).alias("c" + c)
    return to.groupBy("label").agg(F.sum("n").alias("size"), w("x"), w("y"), w("z")).withColumnRenamed("size", "n")


def apply_mapping(voxels: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Relabel voxels by a region-sized mapping (label, target)."""
    m = mapping.select(F.col("label").alias("_from"), F.col("target").alias("_to"))
    out = voxels.join(m, voxels[label] == F.col("_from"), "left")
    return out.withColumn(label, F.coalesce("_to", label)).drop("_from", "_to")


def first_seen_mapping(voxels: DataFrame, component: str = "component", by: tuple[str, ...] = ()) -> DataFrame:
    """Components numbered from 1 by their first voxel: (component, label), for each ``by``. The window has a row per component."""
    firsts = voxels.groupBy(*by, component).agg(F.min("idx").alias("first"))
    return firsts.select(*by, component, F.row_number().over(Window.partitionBy(*by).orderBy("first")).cast("int").alias("label"))


def clean_mapping(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels present, but 0, renumbered without gaps: (label, target)."""
    some = labels.where(F.col(label) > 0).select(F.col(label).alias("label")).distinct()
    return some.select("label", F.dense_rank().over(Window.orderBy("label")).cast("int").alias("target"))


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Position of every row in a total order, from 0, without a one-task window.

    Rows are range-partitioned and ranked within partitions; the partitions' sizes (a row each) give
    the offsets. The ranged rows are written once, so that both uses see the same partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_r", own).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_r")).drop("_p", "_o", "_r")

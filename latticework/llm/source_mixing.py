"""Mixing sources to target weights by Pareto order sampling.

A source's target says how often its words are taken on average: the whole part gives every
document that many certain copies, the rest is a share of words to be drawn. For the draw a
document's inclusion probability p falls with its length, and documents are ranked by random
odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)); the first ones are taken until the
source's share of words is reached as nearly as whole documents allow. u comes from a digest
of seed and doc_id, so reruns agree.

No source is ranked in one task: ranks are first counted in bins, and only the bin in which the
share is reached is ordered. What each document needs to know is one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import common as C

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 4096
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the total by weight, none
    above ``most`` times its size, the excess reshared by weight among the others.

    In order of size over weight the sources at their limit come first, so running sums find them.
    The windows span a row per source.
    """
    k = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % k + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"all_size": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    t = t.withColumn("capped", (F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")) * F.col("w") > F.col("cap"))
    full = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everything), F.lit(0.0))
    level = F.try_divide(F.col("all_size") - full("cap"), F.col("all_w") - full("w"))
    return t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", level * F.col("w")))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """All rows and columns of docs, then size, source_size, target, copies and taken (= copies * size).

    Size: words of the text (null: 0). Null is a source of its own, the last one. Documents
    without words are never taken. Rows that repeat a doc_id share its fate. An empty table
    gives an empty result; columns of docs named like the added ones are replaced.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    own = docs.drop("size", "source_size", "target", "copies", "taken")
    own = own.withColumns({"_size": F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long"), "_u": u})
    base = C.stage(own.select("doc_id", "source", F.col("_size").alias("size"), F.col("_u").alias("u")), "mix-sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(totals.select("source", "source_size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = goal.withColumn("whole", F.floor(rate).cast("long")).withColumn("share", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = C.stage(goal.withColumn("mean", F.greatest(F.lit(1.0), F.col("source_size") / F.col("n"))).drop("n"), "mix-targets")
    few = goal.count() <= BROADCAST_SOURCES
    per_source = lambda left, right: left.join((F.broadcast(right) if few else right).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    def ranked(df: DataFrame, size: str, u: str) -> DataFrame:
        """Rank by random odds over inclusion odds, as q / (1 + q) in (0, 1)."""
        lean = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.sqrt(F.sqrt(F.col("mean") / F.greatest(F.col(size), F.lit(1))))))
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), lean * F.col("share") / F.greatest(F.col("source_size"), F.lit(1))))
        q = (F.col(u) / (1 - F.col(u))) / (p / (1 - p))
        return df.withColumn("_r", q / (1 + q)).withColumn("_bin", F.floor(F.col("_r") * BINS).cast("int"))

    drawn = ranked(per_source(base.where("size > 0"), goal), "size", "u").where("share > 0")
    bins = drawn.groupBy("source", "share", "_bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("_bin"))
    hit = bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).where("before < share and share <= upto")
    edge = hit.select("source", F.col("_bin"), "before")
    inside = drawn.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (drawn["_bin"] == edge["_bin"])).select("source", "doc_id", "size", "share", "before", "_r")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("_r", "doc_id"))
    inside = inside.withColumn("gap", F.abs(upto - F.col("share")))
    start = hit.select("source", (F.col("share") - F.col("before")).alias("gap"), (F.col("_bin") / F.lit(float(BINS))).alias("_r"), F.lit(None).cast("long").alias("doc_id"))
    cut = inside.select("source", "gap", "_r", "doc_id").unionByName(start).groupBy("source").agg(F.min_by(F.struct("_r", "doc_id"), F.struct("gap", "_r", "doc_id")).alias("cut"))
    cut = per_source(goal, C.stage(cut, "mix-cuts")).withColumn("cut_r", F.col("cut._r")).withColumn("cut_id", F.col("cut.doc_id")).drop("cut")
    out = ranked(per_source(own, cut), "_size", "_u")
    first = (F.col("_r") < F.col("cut_r")) | ((F.col("_r") == F.col("cut_r")) & F.coalesce(F.col("doc_id") <= F.col("cut_id"), F.col("doc_id").isNull() & F.col("cut_id").isNotNull()))
    # a share which all ranked words together don't reach (rounding) takes them all
    extra = F.when((F.col("share") > 0) & (F.col("_size") > 0), F.coalesce(first, F.lit(True))).otherwise(F.lit(False))
    copies = F.when(F.col("_size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    out = out.withColumns({"size": F.col("_size"), "copies": copies}).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("_size", "_u", "_r", "_bin", "whole", "share", "mean", "cut_r", "cut_id")

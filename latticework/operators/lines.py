"""Line sets and graph attributes: segments, endings, bends, volumes, ranges, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _vec(a: Column, b: Column) -> list[Column]:
    return [a[c] - b[c] for c in XYZ]


def _norm(v) -> Column:
    return F.sqrt(sum((c * c for c in v), F.lit(0.0)))


def _angle(v, w) -> Column:
    dot = sum((a * b for a, b in zip(v, w)), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, _norm(v) * _norm(w)))))


def segments(points: DataFrame, radius: str | None = None, bend: float | None = 2.0) -> DataFrame:
    """Consecutive points of every line: (line_id, seg, pre, start, end, post, radii, sphere).

    Before the first and after the last point the line is mirrored. At a bend sharper than ``bend``
    radians the neighbouring segment no longer smooths, and a sphere joins the two unless the line ends.
    """
    w = Window.partitionBy("line_id").orderBy("point_idx")
    r = F.abs(F.col(radius)) if radius else F.lit(1.0)
    p = F.struct(*XYZ, r.cast("double").alias("r"))
    at = lambda k: (F.lead(p, k) if k > 0 else F.lag(p, -k)).over(w)
    s = points.select("line_id", F.col("point_idx").alias("seg"), p.alias("start"), at(-1).alias("pre"), at(1).alias("end"), at(2).alias("post")).where("end is not null")
    mirror = lambda a, b: F.struct(*[(2 * F.col(a)[c] - F.col(b)[c]).alias(c) for c in XYZ], F.col(a)["r"].alias("r"))
    s = s.withColumn("inner", F.col("post").isNotNull())
    s = s.withColumns({"pre": F.coalesce("pre", mirror("start", "end")), "post": F.coalesce("post", mirror("end", "start"))})
    if bend is None:
        return s.withColumn("sphere", F.lit(False)).drop("inner")
    ahead = _angle(_vec(F.col("pre"), F.col("start")), _vec(F.col("end"), F.col("start"))) < bend
    behind = _angle(_vec(F.col("post"), F.col("end")), _vec(F.col("start"), F.col("end"))) < bend
    s = s.withColumns({"a": F.coalesce(ahead, F.lit(False)), "b": F.coalesce(behind, F.lit(False))})
    return s.withColumns({"pre": F.when(F.col("a"), mirror("start", "end")).otherwise(F.col("pre")), "post": F.when(F.col("b"), mirror("end", "start")).otherwise(F.col("post")), "sphere": F.col("b") & F.col("inner")}).drop("a", "b", "inner")


def endings(points: DataFrame) -> DataFrame:
    """First and last point of every line; a line of one point gives one."""
    by = points.groupBy("line_id").agg(F.min("point_idx").alias("lo"), F.max("point_idx").alias("hi"))
    return points.join(by, "line_id").where("point_idx in (lo, hi)").drop("lo", "hi")


def nodes(rows: DataFrame, radius: str | None = None, color: str | None = None) -> DataFrame:
    """Spheres: position, radius (1 by default, never negative), colour value (0 by default)."""
    r = F.abs(F.col(radius)).cast("double") if radius else F.lit(1.0)
    c = F.col(color).cast("double") if color else F.lit(0.0)
    return rows.select(*[x for x in rows.columns if x not in ("radius", "color")], F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("radius"), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias("color"))


def bounding_box(*tables: DataFrame) -> DataFrame:
    every = tables[0].select(*XYZ)
    for t in tables[1:]:
        every = every.unionByName(t.select(*XYZ))
    return every.agg(*[f(c).alias(f"{c}_{n}") for c in XYZ for f, n in ((F.min, "min"), (F.max, "max"))])


def display_box(box: DataFrame, margin: float | Column) -> DataFrame:
    """The box widened on every side by the largest radius shown."""
    m = margin if isinstance(margin, Column) else F.lit(margin)
    return box.select(*[((F.col(c) - m) if c.endswith("min") else (F.col(c) + m)).alias(c) for c in box.columns])


def volumes(segs: DataFrame, points: DataFrame, radius: str | None = None) -> DataFrame:
    """Sum of segment volumes over pi, sum of sphere volumes over pi, largest radii.

    A segment is a cylinder, or a cone's stump where its radii differ.
    """
    r0, r1 = F.col("start.r"), F.col("end.r")
    h = _norm(_vec(F.col("end"), F.col("start")))
    big, small = F.greatest(r0, r1), F.least(r0, r1)
    full = h * big / F.abs(r1 - r0)
    stump = (big * big * full - small * small * (full - h)) / 3
    s = segs.agg(F.coalesce(F.sum(F.when(F.abs(r0 - r1) <= 1e-5, big * big * h).otherwise(stump)), F.lit(0.0)).alias("tube_volume"), F.coalesce(F.max(big), F.lit(0.0)).alias("max_tube"))
    r = F.abs(F.col(radius)).cast("double") if radius else F.lit(1.0)
    p = points.agg(F.coalesce(F.sum(4.0 / 3.0 * r * r * r), F.lit(0.0)).alias("sphere_volume"), F.coalesce(F.max(r), F.lit(0.0)).alias("max_sphere"))
    return s.crossJoin(p)  # two rows of one


def radius_scales(box: DataFrame, volume: DataFrame) -> DataFrame:
    """Largest sensible scale of tubes, nodes and endings, and the one to begin with (a quarter).

    The box's volume takes the x extent twice and no extent under a tenth of the longest.
    """
    d = {c: F.col(f"{c}_max") - F.col(f"{c}_min") for c in XYZ}
    least = 0.1 * F.greatest(*d.values())
    at_least = lambda c: F.greatest(least, d[c])
    room = at_least("x") * at_least("y") * at_least("x")
    t = box.crossJoin(volume)  # one row each
    tube = F.coalesce(F.sqrt(F.try_divide(0.2 * room, F.lit(math.pi) * F.col("tube_volume"))), F.lit(0.0))
    node = F.coalesce(F.pow(F.try_divide(0.5 * room, F.lit(math.pi) * F.col("sphere_volume")), 1.0 / 3.0), F.lit(0.0))
    t = t.select(tube.alias("tube_max"), node.alias("node_max"))
    return t.select("tube_max", "node_max", (1.5 * F.col("node_max")).alias("ending_max"), (0.25 * F.col("tube_max")).alias("tube"), (0.25 * F.col("node_max")).alias("node"))


def attribute_ranges(rows: DataFrame, *columns: str) -> DataFrame:
    """(attribute, vmin, vmax) of numeric columns."""
    one = rows.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"lo_{c}").alias("vmin"), F.col(f"hi_{c}").alias("vmax")) for c in columns])).alias("r")).select("r.*")


def eligible_attributes(rows: DataFrame, kind: str, labels: tuple[str, ...] = ()) -> list[str]:
    """Attributes for colour (float and int) or radius (those without labels)."""
    ok = [f.name for f in rows.schema if f.dataType.simpleString() in ("float", "double", "int")]
    return [c for c in ok if kind == "color" or c not in labels]


def colormap_texel(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """Texture coordinate of a value: the outer texels take what is out of range."""
    v = (value - lo) / (hi - lo)
    return F.when(v < 0, F.lit(1 / (2 * n))).when(v > 1, F.lit(1 - 1 / (2 * n))).otherwise((1 - 3 / n) * v + 1.5 / n)


def colormap_samples(colormap: DataFrame, lo: float, hi: float, size: int) -> DataFrame:
    """(slot, value, r, g, b): a colormap (idx, r, g, b) sampled from one step under its minimum."""
    n = colormap.count()
    size = min(256, size)
    step = (hi - lo) / (size - 3)
    s = colormap.sparkSession.range(size).select(F.col("id").alias("slot"), (F.lit(lo) + (F.col("id") - 1) * F.lit(step)).alias("value"))
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col("value") - lo) / (hi - lo) * (n - 1)))
    s = s.withColumn("at", at).withColumn("i", F.floor("at").cast("int")).withColumn("f", F.col("at") - F.col("i"))
    side = lambda k: colormap.select((F.col("idx") - k).alias("i"), *[F.col(c).alias(f"{c}{k}") for c in "rgb"])
    s = s.join(F.broadcast(side(0)), "i").join(F.broadcast(side(1)), "i", "left")  # at most 256 rows
    lerp = lambda c: (F.col(c + "0") + F.col("f") * (F.coalesce(c + "1", c + "0") - F.col(c + "0"))).cast("int").alias(c)
    return s.select("slot", "value", *[lerp(c) for c in "rgb"])


def segment_color(start: list[Column], end: list[Column], s: Column, selected: tuple[Column, Column]) -> list[Column]:
    """RGB between a segment's ends; a selected end is red."""
    red = [1.0, 0.0, 0.0]
    a = [F.when(selected[0], F.lit(x)).otherwise(c) for x, c in zip(red, start)]
    b = [F.when(selected[1], F.lit(x)).otherwise(c) for x, c in zip(red, end)]
    return [p * (1 - s) + q * s for p, q in zip(a, b)]


def label_slots(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, slot): labels 0..252 have the slot after their number; slot 254 is grey."""
    return labels.where(F.col(label).between(0, 252)).select(F.col(label).alias("label"), (F.col(label) + 1).alias("slot")).distinct()


def label_colormap(colors: DataFrame, order: str) -> DataFrame:
    """(slot, r, g, b) from (label, r, g, b): the first colour of labels 0..252 by ``order``, and dark grey in slot 254."""
    spark = colors.sparkSession
    first = colors.where("label between 0 and 252").groupBy((F.col("label") + 1).cast("long").alias("slot")).agg(F.min_by(F.struct("r", "g", "b"), order).alias("c"))
    grey = spark.createDataFrame([(254, 0.1, 0.1, 0.1)], "slot long, r double, g double, b double")
    return first.select("slot", "c.*").unionByName(grey)


def color_source(spark: SparkSession, rgb: tuple | None = None, labels: DataFrame | None = None, colormap: DataFrame | None = None, order: str = "label") -> DataFrame:
    """(slot, r, g, b) of a display's colours: a colormap sampled over 0..1 (as 0..255), else labels' colours, else a
    constant colour, else 0.9 grey in all 256 slots."""
    if colormap is not None:
        return colormap_samples(colormap, 0.0, 1.0, 256).select("slot", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    if labels is not None:
        return label_colormap(labels, order)
    return spark.range(256).select(F.col("id").alias("slot"), *[F.lit(float(x)).alias(c) for c, x in zip("rgb", rgb or (0.9, 0.9, 0.9))])


def toggle_selection(selection: DataFrame, clicked: int, extend: bool) -> DataFrame:
    """Ordered selection (vertex_id, ord) after a click: alone, or added or removed with ``extend``."""
    own = F.col("vertex_id") == clicked
    spark = selection.sparkSession
    new = spark.createDataFrame([(clicked,)], "vertex_id long")
    if not extend:
        return new.withColumn("ord", F.lit(0).cast("long"))
    last = selection.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"), F.count_if(own).alias("has"))
    add = new.crossJoin(last).where("has = 0").select("vertex_id", (F.col("last") + 1).alias("ord"))
    return selection.where(~own).unionByName(add)


def pick(spheres: DataFrame, origin: tuple, direction: tuple, id_column: str = "vertex_id") -> DataFrame:
    """Spheres (x, y, z, radius) which a ray hits, with the distance along the ray; the least is the pick."""
    length = math.sqrt(sum(d * d for d in direction))
    d = [x / length for x in direction]
    to = [F.col(c) - o for c, o in zip(XYZ, origin)]
    along = sum((t * k for t, k in zip(to, d)), F.lit(0.0))
    off = sum((t * t for t in to), F.lit(0.0)) - along * along
    hit = spheres.withColumns({"along": along, "off": off}).where((F.col("off") <= F.col("radius") * F.col("radius")) & (F.col("along") >= 0))
    return hit.select(id_column, (F.col("along") - F.sqrt(F.greatest(F.lit(0.0), F.col("radius") * F.col("radius") - F.col("off")))).alias("distance"))

"""Queries over the derived lattice and its regions, landmarks and lines, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticework.functions import lattice as LF
from latticework.operators import distance as D
from latticework.operators import labels as LB
from latticework.operators import lines as LN
from latticework.operators import metrics as M
from latticework.operators import neighborhood as N
from latticework.operators import regions as R
from latticework.operators import segmentation as S
from latticework.plans import folds as SQL
from latticework.plans.registry import query
from latticework.sources import volumes as V

G = V.GEOMETRY
SIDE = 24
SPHERE = 256
_OFF = lambda name, shifts: f"{name}(k, dx, dy, dz) AS (VALUES {', '.join(str((k, *o)) for k, o in enumerate(shifts))})"

BASE = f"""
WITH cells AS (SELECT l_orderkey % 24 AS x, l_partkey % 24 AS y, l_suppkey % 24 AS z, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
grid AS (
  SELECT (pz.i * 24 + py.i) * 24 + px.i AS idx, px.i AS x, py.i AS y, pz.i AS z, coalesce(c.v, 0.0) AS v
  FROM range(24) px(i) CROSS JOIN range(24) py(i) CROSS JOIN range(24) pz(i)
  LEFT JOIN cells c ON c.x = px.i AND c.y = py.i AND c.z = pz.i),
vox AS (
  SELECT *, CASE WHEN v < 100 THEN 0 ELSE 1 + x // 6 + 4 * (y // 6) + 16 * (z // 6) END AS a,
         CASE WHEN v < 100 THEN 0 ELSE 1 + x // 8 + 3 * (y // 8) + 9 * (z // 8) END AS b,
         CASE WHEN (x + y + z) % 7 = 0 THEN 0 ELSE 1 END AS mask,
         x * 1.0 AS px, y * 1.5 AS py, z * 2.0 AS pz FROM grid),
stats AS (SELECT a AS label, count(*) AS n, avg(px) AS cx, avg(py) AS cy, avg(pz) AS cz FROM vox WHERE a > 0 GROUP BY a),
{_OFF('faces', LF.forward('6'))}, {_OFF('half18', LF.forward('18'))}, {_OFF('half26', LF.forward('26'))}, {_OFF('corners', LF.forward('corners26'))},
{_OFF('all6', LF.offsets(6))}, {_OFF('all14', LF.offsets(14))}, {_OFF('all18', LF.offsets(18))}, {_OFF('all26', LF.offsets(26))},
contacts AS (
  SELECT least(p.a, q.a) AS src, greatest(p.a, q.a) AS dst, count(*) AS faces
  FROM vox p CROSS JOIN faces o JOIN vox q ON q.x = p.x + o.dx AND q.y = p.y + o.dy AND q.z = p.z + o.dz WHERE p.a <> q.a GROUP BY ALL),
edges AS (
  SELECT DISTINCT least(p.a, q.a) AS src, greatest(p.a, q.a) AS dst
  FROM vox p CROSS JOIN corners o JOIN vox q ON q.x = p.x + o.dx AND q.y = p.y + o.dy AND q.z = p.z + o.dz
  WHERE p.a > 0 AND q.a > 0 AND p.a <> q.a AND q.x > 0 AND q.y > 0 AND q.z > 0),
ends AS (SELECT src AS label, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges),
degrees AS (SELECT s.label, count(e.other) AS degree FROM stats s LEFT JOIN ends e ON e.label = s.label GROUP BY s.label),
small AS (SELECT label FROM stats WHERE n < (SELECT avg(n) FROM stats)),
marks AS (SELECT s_suppkey AS landmark_id, (s_suppkey % 24) + 0.3 AS x, ((s_suppkey * 7) % 24) * 1.5 + 0.4 AS y, ((s_suppkey * 5) % 24) * 2.0 + 0.6 AS z FROM supplier),
pts AS (
  SELECT o_custkey AS line_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) - 1 AS point_idx,
         (o_orderkey % 97) * 1.0 AS x, (o_orderkey % 89) * 1.0 AS y, (o_orderkey % 83) * 1.0 AS z, o_totalprice / 10000 AS data FROM orders)
"""


def vox(spark, sf_dir):
    return V.order_lattice(spark, sf_dir).withColumns({"px": F.col("x") * 1.0, "py": F.col("y") * 1.5, "pz": F.col("z") * 2.0})


def stats(v):
    return LB.label_stats(v, G, "a")


def edges(v):
    return R.adjacency(v, "a")


def small(st):
    return st.join(F.broadcast(st.agg(F.avg("n").alias("m"))), F.col("n") < F.col("m")).select("label")  # m is one row


def marks(spark, sf_dir):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("landmark_id"), ((k % 24) + 0.3).alias("x"), ((k * 7) % 24 * 1.5 + 0.4).alias("y"), ((k * 5) % 24 * 2.0 + 0.6).alias("z"))


def pts(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("line_id"), (F.row_number().over(w) - 1).alias("point_idx"), (k % 97 * 1.0).alias("x"), (k % 89 * 1.0).alias("y"), (k % 83 * 1.0).alias("z"), (F.col("o_totalprice") / 10000).alias("data"))


def q(name, columns, sql=None):
    """Register a query over (voxels) or, if the function takes more, over what it asks for by name."""
    return query(name, columns, sql, BASE)


# ---------------------------------------------------------------- sources and lattice


@q("lattice_scan", "idx:l x:l y:l z:l v:d a:l b:l mask:l", "SELECT idx, x, y, z, v, a, b, mask FROM vox")
def _(spark, d):
    return vox(spark, d)


@q("grid_index_roundtrip", "idx:l back:l x:l y:l z:l", "SELECT idx, idx AS back, x, y, z FROM vox")
def _(spark, d):
    v = vox(spark, d)
    x, y, z = LF.grid_position(F.col("idx"), SIDE, SIDE)
    v = v.select("idx", x.alias("x"), y.alias("y"), z.alias("z"))
    return v.withColumn("back", LF.linear_index(F.col("x"), F.col("y"), F.col("z"), SIDE, SIDE))


@q("label_cast_uint16", "idx:l label:l", "SELECT idx, a AS label FROM vox")
def _(spark, d):
    return V.cast_labels(vox(spark, d).select("idx", F.col("a").cast("double").alias("label")))


@q("threshold_filter", "idx:l v:d node:l", "SELECT idx, v, row_number() OVER (ORDER BY idx) - 1 AS node FROM vox WHERE v >= 100")
def _(spark, d):
    return LB.global_rank(vox(spark, d).where("v >= 100").select("idx", "v"), F.col("idx"), name="node")


@q("global_sort_join", "idx:l rank:l", "SELECT idx, row_number() OVER (ORDER BY v DESC, idx DESC) - 1 AS rank FROM vox")
def _(spark, d):
    return LB.global_rank(vox(spark, d).select("idx", "v"), F.desc("v"), F.desc("idx"))


@q("global_sort_split", "idx:l rank:l", "SELECT idx, row_number() OVER (ORDER BY v, idx) - 1 AS rank FROM vox")
def _(spark, d):
    return LB.global_rank(vox(spark, d).select("idx", "v"), F.asc("v"), F.asc("idx"))


@q("world_position", "idx:l px:d py:d pz:d", "SELECT idx, px, py, pz FROM vox")
def _(spark, d):
    return V.order_lattice(spark, d).select("idx", *G.position())


@q("box_selection", "idx:l label:l", "SELECT idx, CASE WHEN abs(x-10)<=3 AND abs(y-2)<=3 AND abs(z-20)<=3 THEN 1 ELSE 0 END AS label FROM vox")
def _(spark, d):
    near = lambda c, at: F.abs(F.col(c) - at) <= 3
    return vox(spark, d).select("idx", F.when(near("x", 10) & near("y", 2) & near("z", 20), 1).otherwise(0).alias("label"))


@q("relabel_selected", "idx:l label:l", "SELECT idx, coalesce(r.rank, 0) AS label FROM vox LEFT JOIN (VALUES (3, 1), (7, 2), (21, 3), (42, 4)) r(l, rank) ON r.l = a")
def _(spark, d):
    picked = spark.createDataFrame([(x,) for x in (42, 3, 21, 7)], "label int")
    ranks = picked.select("label", F.dense_rank().over(Window.orderBy("label")).alias("target"))
    v = vox(spark, d).join(F.broadcast(ranks), F.col("a") == F.col("label"), "left")  # the selection
    return v.select("idx", F.coalesce("target", F.lit(0)).alias("label"))


@q("attribute_range_filter", "label:l n:l", "SELECT label, n FROM stats WHERE n BETWEEN 50 AND 120")
def _(spark, d):
    return stats(vox(spark, d)).where(F.col("n").between(50, 120))


for _kind in (6, 14, 18, 26):

    @q(f"neighbors_{_kind}", "idx:l n:l", f"SELECT p.idx, count(*) AS n FROM vox p CROSS JOIN all{_kind} o JOIN vox q ON q.x = p.x + o.dx AND q.y = p.y + o.dy AND q.z = p.z + o.dz GROUP BY p.idx")
    def _(spark, d, kind=_kind):
        v = vox(spark, d)
        e = LF.with_neighbors(v, LF.offsets(kind), "idx").where(LF.in_grid(F.col("nx"), F.col("ny"), F.col("nz"), G.dims))
        return e.groupBy("idx").agg(F.count("*").alias("n"))

    for _dir, _op in (("higher", ">"), ("lower", "<")):

        @q(
            f"neighbors_{_kind}_{_dir}", "idx:l n:l nsum:l",
            f"SELECT p.idx, count(*) AS n, sum(q.idx) AS nsum FROM vox p CROSS JOIN all{_kind} o JOIN vox q ON q.x = p.x + o.dx AND q.y = p.y + o.dy AND q.z = p.z + o.dz "
            f"WHERE p.v >= 100 AND q.v >= 100 AND (q.v, q.idx) {_op} (p.v, p.idx) GROUP BY p.idx",
        )
        def _(spark, d, kind=_kind, up=_dir == "higher"):
            e = LF.neighbor_pairs(vox(spark, d).where("v >= 100"), LF.offsets(kind), ("idx", "v"), {"qi": "idx", "qv": "v"})
            own, other = F.struct(F.col("v").alias("v"), F.col("idx").alias("i")), F.struct(F.col("qv").alias("v"), F.col("qi").alias("i"))
            return e.where(other > own if up else other < own).groupBy("idx").agg(F.count("*").alias("n"), F.sum("qi").alias("nsum"))


# ---------------------------------------------------------------- aggregates

_HIST = """SELECT r.i AS bin, coalesce(c.n, 0) AS n FROM range(256) r(i) LEFT JOIN (
  SELECT CAST(least(255, floor((v - lo) / (hi - lo) * 256)) AS INT) AS bin, count(*) AS n FROM vox, (SELECT min(v) AS lo, max(v) AS hi FROM vox) GROUP BY 1) c ON c.bin = r.i"""


@q("field_range", "vmin:d vmax:d", "SELECT min(v) AS vmin, max(v) AS vmax FROM vox")
def _(spark, d):
    return LB.field_range(vox(spark, d), "v")


@q("default_parameters", "threshold:d persistence:d min_size:l", "SELECT (min(v) + max(v)) / 2 AS threshold, 0.05 * (max(v) - min(v)) AS persistence, 50 AS min_size FROM vox")
def _(spark, d):
    return LB.default_parameters(vox(spark, d), "v")


@q("histogram_256", "bin:l n:l", _HIST)
def _(spark, d):
    return LB.histogram(vox(spark, d), "v")


@q(
    "robust_range", "vmin:d vmax:d",
    f"""SELECT lo + (hi - lo) / 256 * coalesce(imin, 0) AS vmin, lo + (hi - lo) / 256 * least(255, coalesce(stop + 1, 0)) AS vmax FROM (
  SELECT max(CASE WHEN upto <= round_even(t * 0.05, 0) THEN bin END) AS imin, max(CASE WHEN upto - n < round_even(t * 0.95, 0) THEN bin END) AS stop FROM (
    SELECT bin, n, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS t FROM ({_HIST}))), (SELECT min(v) AS lo, max(v) AS hi FROM vox)""",
)
def _(spark, d):
    return LB.robust_range(vox(spark, d), "v")


@q("label_sizes", "label:l n:l", "SELECT a AS label, count(*) AS n FROM vox GROUP BY a")
def _(spark, d):
    return LB.label_sizes(vox(spark, d), "a")


@q("label_centroids", "label:l n:l cx:d cy:d cz:d", "SELECT * FROM stats")
def _(spark, d):
    return stats(vox(spark, d))


@q("centroid_refresh", "label:l n:l cx:d cy:d cz:d", "SELECT * FROM stats WHERE label IN (3, 7, 21)")
def _(spark, d):
    return LB.label_stats(vox(spark, d), G, "a", F.col("a").isin(3, 7, 21))


@q(
    "merged_centroids", "label:l n:l cx:d cy:d cz:d",
    "SELECT t AS label, sum(n) AS n, sum(cx * n) / sum(n) AS cx, sum(cy * n) / sum(n) AS cy, sum(cz * n) / sum(n) AS cz FROM (SELECT *, CASE WHEN label IN (1, 2, 5) THEN 6 ELSE label END AS t FROM stats) GROUP BY t",
)
def _(spark, d):
    return LB.merged_centroids(stats(vox(spark, d)), R.meld_chain([1, 2, 5, 6], spark))


@q("inside_mean", "label:l n:l mean:d", "SELECT a AS label, count(*) AS n, avg(v) AS mean FROM vox WHERE a > 0 GROUP BY a")
def _(spark, d):
    return LB.label_mean(vox(spark, d), "a", "v")


@q("segment_count", "segments:l", "SELECT count(DISTINCT a) AS segments FROM vox WHERE a > 0")
def _(spark, d):
    return S.segment_count(vox(spark, d).select(F.col("a").alias("label")))


@q("clean_labels", "label:l target:l", "SELECT label, row_number() OVER (ORDER BY label) AS target FROM stats")
def _(spark, d):
    return LB.clean_mapping(vox(spark, d), "a")


@q("first_seen_relabel", "idx:l label:l", "SELECT v.idx, f.label FROM vox v JOIN (SELECT a, row_number() OVER (ORDER BY first) AS label FROM (SELECT a, min(idx) AS first FROM vox WHERE a > 0 GROUP BY a)) f ON f.a = v.a")
def _(spark, d):
    v = vox(spark, d).where("a > 0")
    return v.join(LB.first_seen_mapping(v, "a"), "a").select("idx", "label")


# ---------------------------------------------------------------- partition metrics

_CT = "ct AS (SELECT a AS i, b AS j, count(*) AS n FROM vox WHERE mask <> 0 GROUP BY ALL), ni AS (SELECT i, sum(n) AS s FROM ct GROUP BY i), nj AS (SELECT j, sum(n) AS s FROM ct GROUP BY j), t AS (SELECT sum(n) AS s FROM ct)"
_VI = "(SELECT sum(ct.n / t.s * (ln(ni.s / ct.n) + ln(nj.s / ct.n))) FROM ct JOIN ni USING (i) JOIN nj USING (j), t)"
_PAIRS = lambda tab, c: f"(SELECT sum(CAST({c} AS DOUBLE) * ({c} - 1)) FROM {tab})"
_RI = f"(({_PAIRS('t', 's')} - {_PAIRS('ni', 's')} - {_PAIRS('nj', 's')} + 2 * {_PAIRS('ct', 'n')}) / {_PAIRS('t', 's')})"
_DICE = "(SELECT 2.0 * count(*) FILTER (a > 0 AND b > 0) / (count(*) FILTER (a > 0) + count(*) FILTER (b > 0)) FROM (SELECT v, mask, a, CASE WHEN v >= 130 THEN b ELSE 0 END AS b FROM vox) WHERE mask <> 0)"


def _table(v, keep="mask <> 0"):
    return M.contingency(v, "a", "b", F.expr(keep))


@q("contingency", "i:l j:l n:l", "SELECT a AS i, b AS j, count(*) AS n FROM vox WHERE mask <> 0 GROUP BY ALL")
def _(spark, d):
    return _table(vox(spark, d))


@q("dice", "dice:d", f"SELECT {_DICE} AS dice")
def _(spark, d):
    return M.dice(vox(spark, d).withColumn("b", F.when(F.col("v") >= 130, F.col("b")).otherwise(0)), "a", "b")


@q("variation_of_information", "vi:d", f"WITH {_CT} SELECT {_VI} AS vi")
def _(spark, d):
    return M.variation_of_information(_table(vox(spark, d)))


@q("rand_index", "rand_index:d", f"WITH {_CT} SELECT {_RI} AS rand_index")
def _(spark, d):
    return M.rand_index(_table(vox(spark, d), "mask >= 0.5"))


@q("partition_metrics", "vi:d rand_index:d dice:d", f"WITH {_CT} SELECT {_VI} AS vi, {_RI} AS rand_index, {_DICE} AS dice")
def partition_metrics(spark, d):
    v = vox(spark, d)
    t = _table(v)
    other = M.dice(v.withColumn("b", F.when(F.col("v") >= 130, F.col("b")).otherwise(0)), "a", "b")
    return M.variation_of_information(t).crossJoin(M.rand_index(t)).crossJoin(other)  # three rows of one


@q(
    "compare_all_pairs", "m1:s m2:s vi:d rand_index:d",
    """WITH l AS (SELECT 'a' AS m, idx, a AS l FROM vox UNION ALL SELECT 'b', idx, b FROM vox UNION ALL SELECT 'c', idx, CASE WHEN a > 0 THEN 1 ELSE 0 END FROM vox UNION ALL SELECT 'd', idx, x // 12 FROM vox UNION ALL SELECT 'e', idx, z // 12 FROM vox),
c AS (SELECT p.m AS m1, q.m AS m2, p.l AS i, q.l AS j, count(*) AS n FROM l p JOIN l q ON p.idx = q.idx AND p.m < q.m GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY m1, m2, i) AS ni, sum(n) OVER (PARTITION BY m1, m2, j) AS nj, sum(n) OVER (PARTITION BY m1, m2) AS t FROM c),
s AS (SELECT m1, m2, sum(n / t * (ln(ni / n) + ln(nj / n))) AS vi, sum(n * (n - 1.0)) AS s, sum(n * (ni - 1.0)) AS r, sum(n * (nj - 1.0)) AS c, any_value(t) AS t FROM w GROUP BY ALL)
SELECT m1, m2, vi, (t * (t - 1.0) - r - c + 2 * s) / (t * (t - 1.0)) AS rand_index FROM s""",
)
def _(spark, d):
    fields = {"a": F.col("a"), "b": F.col("b"), "c": (F.col("a") > 0).cast("int"), "d": F.floor(F.col("x") / 12).cast("int"), "e": F.floor(F.col("z") / 12).cast("int")}
    rows = F.array(*[F.struct(F.lit(m).alias("method"), c.cast("int").alias("label")) for m, c in fields.items()])
    return M.compare_all(vox(spark, d).select("idx", F.explode(rows).alias("r")).select("idx", "r.*"))


# ---------------------------------------------------------------- landmarks

_MARKED = """
f AS (SELECT landmark_id, (x + 0.5) / 1.0 AS fx, (y + 0.75) / 1.5 AS fy, (z + 1.0) / 2.0 AS fz FROM marks),
near AS (SELECT landmark_id, a FROM f JOIN vox v ON v.x = CAST(floor(fx) AS INT) AND v.y = CAST(floor(fy) AS INT) AND v.z = CAST(floor(fz) AS INT)),
around AS (SELECT landmark_id, count(DISTINCT a) AS k, max(a) AS a FROM f, (VALUES (0,0,0),(0,0,1),(0,1,0),(0,1,1),(1,0,0),(1,0,1),(1,1,0),(1,1,1)) c(i, j, k)
  JOIN vox v ON v.x = CASE i WHEN 0 THEN floor(fx) ELSE ceil(fx) END AND v.y = CASE j WHEN 0 THEN floor(fy) ELSE ceil(fy) END AND v.z = CASE k WHEN 0 THEN floor(fz) ELSE ceil(fz) END
  WHERE v.a > 0 GROUP BY landmark_id),
hits AS (SELECT m.landmark_id, CASE WHEN n.a > 0 THEN n.a WHEN r.k = 1 THEN r.a ELSE 0 END AS label FROM marks m LEFT JOIN near n USING (landmark_id) LEFT JOIN around r USING (landmark_id)),
lt AS (SELECT l.i AS label, count(h.landmark_id) AS hits FROM range(65) l(i) LEFT JOIN hits h ON h.label = l.i GROUP BY 1)"""


def _hits(spark, d):
    return M.landmark_labels(marks(spark, d), vox(spark, d), G, "a")


@q("landmark_labels", "landmark_id:l label:l", f"WITH {_MARKED} SELECT * FROM hits")
def _(spark, d):
    return _hits(spark, d)


@q("landmark_labels_search", "landmark_id:l label:l", SQL.search(SIDE))
def _(spark, d):
    return M.landmark_labels_search(marks(spark, d), vox(spark, d), G, "a")


@q(
    "landmark_table", "label:l hits:l correct:l oversegmented:l cluster2:l cluster3:l cluster4:l cluster5:l",
    f"WITH {_MARKED} SELECT label, hits, CAST(label > 0 AND hits = 1 AS INT) AS correct, CAST(label > 0 AND hits = 0 AS INT) AS oversegmented, " + ", ".join(f"CAST(label > 0 AND hits = {n} AS INT) AS cluster{n}" for n in range(2, 6)) + " FROM lt",
)
def _(spark, d):
    return M.landmark_table(_hits(spark, d), 64)


_SUMMARY = """SELECT *, (correct + clusters) / (correct + clusters + oversegmented) AS precision, (correct + clusters) / (correct + clusters + weighted + background) AS recall FROM (
  SELECT count(*) FILTER (label > 0 AND hits = 1) AS correct, count(*) FILTER (label > 0 AND hits > 1) AS clusters, coalesce(sum(hits - 1) FILTER (label > 0 AND hits > 1), 0) AS weighted,
         count(*) FILTER (label > 0 AND hits = 0) AS oversegmented, coalesce(sum(hits) FILTER (label = 0), 0) AS background FROM lt)"""


@q("landmark_summary", "correct:l clusters:l weighted:l oversegmented:l background:l precision:d recall:d", f"WITH {_MARKED} {_SUMMARY}")
def _(spark, d):
    return M.landmark_summary(M.landmark_table(_hits(spark, d), 64))


@q(
    "landmark_sides", "kind:s label:l landmark_id:l",
    f"WITH {_MARKED} SELECT 'background' AS kind, label, landmark_id FROM hits WHERE label = 0 UNION ALL SELECT 'cluster' || count(*), label, max(landmark_id) FROM hits WHERE label > 0 GROUP BY label HAVING count(*) BETWEEN 2 AND 5",
)
def _(spark, d):
    return M.landmark_sides(_hits(spark, d))


@q(
    "landmark_batch", "field:s precision:d recall:d",
    f"""WITH {_MARKED}, two AS (SELECT 'low' AS field, * FROM hits UNION ALL SELECT 'high', landmark_id, CASE WHEN label > 32 THEN label ELSE 0 END FROM hits),
ft AS (SELECT f.field, l.i AS label, count(h.landmark_id) AS hits FROM (VALUES ('low'), ('high')) f(field) CROSS JOIN range(65) l(i) LEFT JOIN two h ON h.label = l.i AND h.field = f.field GROUP BY ALL)
SELECT field, tp / (tp + over) AS precision, tp / (tp + weighted + back) AS recall FROM (
  SELECT field, count(*) FILTER (label > 0 AND hits >= 1) AS tp, count(*) FILTER (label > 0 AND hits = 0) AS over, coalesce(sum(hits - 1) FILTER (label > 0 AND hits > 1), 0) AS weighted, coalesce(sum(hits) FILTER (label = 0), 0) AS back FROM ft GROUP BY field)""",
)
def _(spark, d):
    h = _hits(spark, d)
    both = {"low": h, "high": h.withColumn("label", F.when(F.col("label") > 32, F.col("label")).otherwise(0))}
    tables = [M.landmark_table(t, 64).withColumn("field", F.lit(n)) for n, t in both.items()]
    return M.landmark_summary(tables[0].unionByName(tables[1]), "field")


# ---------------------------------------------------------------- neighbourhoods


@q(
    "box_mean", "idx:l mean:d",
    """SELECT idx, CASE WHEN a > 0 THEN s / n ELSE 0 END AS mean FROM (
  SELECT idx, a, sum(n) OVER (PARTITION BY x, y ORDER BY z RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n, sum(s) OVER (PARTITION BY x, y ORDER BY z RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM (
    SELECT idx, x, y, z, a, sum(n) OVER (PARTITION BY x, z ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n, sum(s) OVER (PARTITION BY x, z ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM (
      SELECT idx, x, y, z, a, sum(CAST(a > 0 AS INT)) OVER (PARTITION BY y, z ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n, sum(CASE WHEN a > 0 THEN v ELSE 0 END) OVER (PARTITION BY y, z ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM vox)))""",
)
def _(spark, d):
    return N.box_mean(vox(spark, d), 3, "a", "v")


_RING = f"ball(dx, dy, dz) AS (SELECT p.i, q.i, r.i FROM range(-2, 3) p(i), range(-2, 3) q(i), range(-2, 3) r(i) WHERE p.i*p.i + q.i*q.i + r.i*r.i <= 4), ring AS (SELECT DISTINCT p.a AS label, q.idx, q.v FROM vox p CROSS JOIN ball o JOIN vox q ON q.x = p.x + o.dx AND q.y = p.y + o.dy AND q.z = p.z + o.dz WHERE p.a > 0 AND q.a = 0)"


@q("dilation_ring", "label:l idx:l", f"WITH {_RING} SELECT label, idx FROM ring")
def _(spark, d):
    return N.dilation_ring(vox(spark, d), 2, "a")


@q(
    "mean_around_labels", "label:l inside_mean:d n:l mean:d",
    f"""WITH {_RING}, i AS (SELECT a AS label, avg(v) AS m FROM vox WHERE a > 0 GROUP BY a)
SELECT l.i AS label, coalesce(any_value(i.m), 0) AS inside_mean, count(r.idx) AS n, coalesce(avg(r.v), 0) AS mean FROM range(1, 65) l(i) LEFT JOIN i ON i.label = l.i LEFT JOIN ring r ON r.label = l.i AND r.v > i.m GROUP BY l.i""",
)
def _(spark, d):
    return N.mean_around_labels(vox(spark, d), 2, 64, "a", "v")


# ---------------------------------------------------------------- region graph

for _name, _kind, _table_name, _first in (("rag_edges_6", "6", "faces", True), ("rag_edges_18", "18", "half18", True), ("rag_edges_26_corners", "corners26", "corners", True), ("rag_edges_26_strict", "26", "half26", False)):
    _skip = "AND q.x > 0 AND q.y > 0 AND q.z > 0" if _first else ""

    @q(_name, "src:l dst:l", f"SELECT DISTINCT least(p.a, q.a) AS src, greatest(p.a, q.a) AS dst FROM vox p CROSS JOIN {_table_name} o JOIN vox q ON q.x = p.x + o.dx AND q.y = p.y + o.dy AND q.z = p.z + o.dz WHERE p.a > 0 AND q.a > 0 AND p.a <> q.a {_skip}")
    def _(spark, d, kind=_kind, first=_first):
        return R.adjacency(vox(spark, d), "a", kind, first)


@q("rag_vertices", "vertex_id:l label:l n:l cx:d cy:d cz:d", "SELECT row_number() OVER (ORDER BY label) - 1 AS vertex_id, * FROM stats")
def _(spark, d):
    return R.vertices(stats(vox(spark, d)))


@q("contacts", "src:l dst:l faces:l material:l", "SELECT *, CASE WHEN src = 0 THEN dst ELSE -1 END AS material FROM contacts")
def _(spark, d):
    return R.patch_material(R.contacts(vox(spark, d), "a"))


@q("edge_lengths", "src:l dst:l length:d", "SELECT src, dst, sqrt((p.cx-q.cx)**2 + (p.cy-q.cy)**2 + (p.cz-q.cz)**2) AS length FROM edges JOIN stats p ON p.label = src JOIN stats q ON q.label = dst")
def _(spark, d):
    v = vox(spark, d)
    return R.edge_lengths(edges(v), stats(v))


@q("degrees", "label:l degree:l", "SELECT * FROM degrees")
def _(spark, d):
    v = vox(spark, d)
    return R.degrees(stats(v), edges(v))


@q("critical_small", "label:l", "SELECT label FROM stats WHERE n < 110")
def _(spark, d):
    return R.critical_small(stats(vox(spark, d)), 110)


@q("critical_near", "label:l", "SELECT DISTINCT unnest([src, dst]) AS label FROM edges JOIN stats p ON p.label = src JOIN stats q ON q.label = dst WHERE sqrt((p.cx-q.cx)**2 + (p.cy-q.cy)**2 + (p.cz-q.cz)**2) < 6.5")
def _(spark, d):
    v = vox(spark, d)
    return R.critical_near(edges(v), stats(v), 6.5)


@q("critical_inside", "label:l", "SELECT label FROM stats WHERE label NOT IN (SELECT dst FROM contacts WHERE src = 0)")
def _(spark, d):
    v = vox(spark, d)
    return R.critical_inside(stats(v), R.contacts(v, "a"))


@q("critical_exterior_only", "label:l", "SELECT label FROM stats WHERE label NOT IN (SELECT unnest([src, dst]) FROM contacts WHERE src > 0)")
def _(spark, d):
    v = vox(spark, d)
    return R.critical_exterior_only(stats(v), R.contacts(v, "a"))


@q("critical_degree", "label:l", "SELECT label FROM degrees WHERE degree > 12 OR degree < 7")
def _(spark, d):
    v = vox(spark, d)
    return R.critical_degree(stats(v), edges(v), 7, 12)


_CC = "RECURSIVE tw AS (SELECT src AS p, dst AS q FROM edges UNION SELECT dst, src FROM edges), reach(label, c) AS (SELECT label, label FROM stats UNION SELECT tw.q, r.c FROM reach r JOIN tw ON tw.p = r.label), cc AS (SELECT label, min(c) AS component FROM reach GROUP BY label)"


@q("region_components", "label:l component:l", f"WITH {_CC} SELECT * FROM cc")
def _(spark, d):
    v = vox(spark, d)
    return R.connected_components(stats(v).select("label"), edges(v))


@q("critical_component_size", "label:l", f"WITH {_CC} SELECT label FROM cc WHERE component IN (SELECT component FROM cc GROUP BY 1 HAVING count(*) < 70)")
def _(spark, d):
    v = vox(spark, d)
    return R.critical_component_size(stats(v), edges(v), 70)


@q("critical_buffer", "label:l", "(SELECT label FROM small UNION SELECT label FROM degrees WHERE degree < 7) EXCEPT SELECT label FROM stats WHERE label % 2 = 0")
def _(spark, d):
    v = vox(spark, d)
    st = stats(v)
    both = R.buffer_add(small(st), R.degrees(st, edges(v)).where("degree < 7"))
    return R.buffer_remove(both, st.where("label % 2 = 0").select("label"))


@q("largest_neighbor", "label:l target:l", "SELECT s.label, coalesce(max_by(e.other, n.n * 1000 - e.other), 0) AS target FROM stats s LEFT JOIN ends e ON e.label = s.label LEFT JOIN stats n ON n.label = e.other GROUP BY s.label")
def _(spark, d):
    v = vox(spark, d)
    return R.largest_neighbor(stats(v), edges(v))


_MELD = "m AS (SELECT label, CASE WHEN label IN (1, 2, 5) THEN 6 ELSE label END AS t FROM stats)"


@q("meld_edges", "src:l dst:l", f"WITH {_MELD} SELECT DISTINCT least(p.t, q.t) AS src, greatest(p.t, q.t) AS dst FROM edges JOIN m p ON p.label = src JOIN m q ON q.label = dst WHERE p.t <> q.t")
def _(spark, d):
    v = vox(spark, d)
    return R.meld(R.meld_chain([1, 2, 5, 6], spark), stats(v), edges(v))[1]


@q("meld_voxels", "idx:l a:l", f"WITH {_MELD} SELECT idx, coalesce(t, 0) AS a FROM vox LEFT JOIN m ON label = a")
def _(spark, d):
    return LB.apply_mapping(vox(spark, d), R.meld_chain([1, 2, 5, 6], spark), "a")


@q("remove_regions", "idx:l a:l", "SELECT idx, CASE WHEN a IN (SELECT label FROM small) THEN 0 ELSE a END AS a FROM vox")
def _(spark, d):
    v = vox(spark, d)
    return LB.apply_mapping(v, R.removal(small(stats(v))), "a")


@q("remove_regions_graph", "src:l dst:l", "SELECT src, dst FROM edges WHERE src NOT IN (SELECT label FROM small) AND dst NOT IN (SELECT label FROM small)")
def _(spark, d):
    v = vox(spark, d)
    st = stats(v)
    return R.meld(R.removal(small(st)), st, edges(v))[1]


@q(
    "clean_graph_vertices", "label:l n:l cx:d cy:d cz:d",
    "SELECT row_number() OVER (ORDER BY label) AS label, n, cx, cy, cz FROM stats WHERE label NOT IN (SELECT label FROM small)",
)
def _(spark, d):
    return _cleaned(vox(spark, d))[0]


@q(
    "clean_graph_edges", "src:l dst:l",
    "WITH m AS (SELECT label, row_number() OVER (ORDER BY label) AS t FROM stats WHERE label NOT IN (SELECT label FROM small)) SELECT p.t AS src, q.t AS dst FROM edges JOIN m p ON p.label = src JOIN m q ON q.label = dst",
)
def _(spark, d):
    return _cleaned(vox(spark, d))[1]


def _cleaned(v):
    """The region graph without its small regions, renumbered without gaps."""
    st = stats(v)
    left = R.meld(R.removal(small(st)), st, edges(v))
    return R.meld(LB.clean_mapping(left[0]), *left)


@q("meld_critical", "label:l target:l", SQL.MELD_CRITICAL)
def _(spark, d):
    v = vox(spark, d)
    st = stats(v)
    return R.meld_critical(small(st), st, edges(v))


@q("threshold_selected", "label:l n:l", "SELECT a AS label, count(*) AS n FROM (SELECT CASE WHEN a IN (SELECT label FROM small) AND v < 130 THEN 0 ELSE a END AS a FROM vox) GROUP BY a")
def _(spark, d):
    v = vox(spark, d)
    return LB.label_sizes(R.threshold_selected(v, small(stats(v)), "v", 130, "a"), "a")


@q("unsupported_regions", "label:l", "SELECT a AS label FROM vox WHERE a > 0 GROUP BY a HAVING max(CASE WHEN v >= 400 THEN 1 ELSE 0 END) = 0")
def _(spark, d):
    return R.unsupported(vox(spark, d).withColumn("ref", (F.col("v") >= 400).cast("int")), "a", "ref")


@q("select_regions", "idx:l a:l", "SELECT idx, a FROM vox WHERE a IN (SELECT label FROM small)")
def _(spark, d):
    v = vox(spark, d)
    return v.join(small(stats(v)), F.col("a") == F.col("label"), "left_semi").select("idx", "a")


@q("exterior_field", "src:l dst:l value:d", "SELECT src, dst, CASE WHEN src = 0 THEN n ELSE 0 END AS value FROM contacts LEFT JOIN stats ON label = dst")
def _(spark, d):
    v = vox(spark, d)
    return R.exterior_field(R.contacts(v, "a"), stats(v).select("label", F.col("n").cast("double").alias("value")))


@q(
    "post_split_edges", "src:l dst:l",
    "SELECT DISTINCT least(p.a, q.a) AS src, greatest(p.a, q.a) AS dst FROM vox p CROSS JOIN half26 o JOIN vox q ON q.x = p.x + o.dx AND q.y = p.y + o.dy AND q.z = p.z + o.dz WHERE p.a > 0 AND q.a > 0 AND p.a <> q.a AND p.v > 130 AND q.v > 130 AND (p.a IN (3, 7) OR q.a IN (3, 7))",
)
def _(spark, d):
    return R.touched_adjacency(vox(spark, d), spark.createDataFrame([(3,), (7,)], "label int"), "v", 130, "a")


@q("connecting_edges", "label:l other:l connected:b", "SELECT label, label - 1 AS other, EXISTS (SELECT 1 FROM edges WHERE src = label - 1 AND dst = label) AS connected FROM stats")
def _(spark, d):
    v = vox(spark, d)
    return R.connecting_edges(stats(v).select("label", (F.col("label") - 1).alias("other")), edges(v))


@q("color_regions", "label:l color:l", SQL.COLORS)
def _(spark, d):
    v = vox(spark, d)
    return R.color_regions(stats(v), edges(v))


@q("improve_colors", "label:l r:d g:d b:d", SQL.improved_colors("label % 3 * 31"))
def _(spark, d):
    v = vox(spark, d)
    k = F.col("label") % 3 * 31
    start = stats(v).select("label", (F.floor(k / 25) / 4).alias("r"), (F.floor(k / 5) % 5 / 4).alias("g"), (k % 5 / 4).alias("b"))
    return R.improve_colors(start, edges(v))


# ---------------------------------------------------------------- segmentation and splits


def _field(spark, d):
    """Values made distinct by the index."""
    return vox(spark, d).withColumn("value", F.col("v") + F.col("idx") / 100000.0)


@q("segment_majority", "idx:l label:l", SQL.segmentation(130, "majority", "60", 5))
def _(spark, d):
    return S.segment(_field(spark, d), 130, S.Rule(persistence=60.0, min_size=5))


@q("segment_value_order", "idx:l label:l", SQL.segmentation(130, "value", "60"))
def _(spark, d):
    return S.segment(_field(spark, d), 130, S.Rule(persistence=60.0, order="value"))


@q("segment_adaptive", "idx:l label:l", SQL.adaptive(130, "0.3"))
def _(spark, d):
    return S.segment(_field(spark, d), 130, S.Rule(persistence=0.3, mode="adaptive"))


_WIDTH = f"""width AS (SELECT vmax - vmin AS width FROM (SELECT lo + (hi - lo) / 256 * coalesce(imin, 0) AS vmin, lo + (hi - lo) / 256 * least(255, coalesce(stop + 1, 0)) AS vmax FROM (
  SELECT max(CASE WHEN upto <= round_even(t * 0.05, 0) THEN bin END) AS imin, max(CASE WHEN upto - n < round_even(t * 0.95, 0) THEN bin END) AS stop FROM (
    SELECT bin, n, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS t FROM ({_HIST}))), (SELECT min(v) AS lo, max(v) AS hi FROM vox))), """


@q("segment_relative", "idx:l label:l", SQL.segmentation(130, "majority", "0.2 * width", before=_WIDTH, beside="width"))
def _(spark, d):
    r = LB.robust_range(vox(spark, d), "v").first()  # one row
    return S.segment(_field(spark, d), 130, S.Rule(persistence=0.2, mode="relative", width=r.vmax - r.vmin))


@q("segment_fast", "idx:l label:l", SQL.segmentation(130, "value", "60"))
def _(spark, d):
    return S.segment_fast(_field(spark, d), 130, S.Rule(persistence=60.0))


@q("segment_fast_min_size", "idx:l label:l", SQL.fast(130, "60", 5))
def _(spark, d):
    return S.segment_fast(_field(spark, d), 130, S.Rule(persistence=60.0, min_size=5))


@q("segment_sweep", "persistence:d idx:l label:l", SQL.sweep(130, "majority", [20.0, 40.0, 60.0]))
def _(spark, d):
    return S.persistence_sweep(_field(spark, d), 130, 20, 60, 20)


@q("join_tree", "cc:l lower:l higher:l", f"WITH {SQL.tree(150)} SELECT * FROM te")
def _(spark, d):
    return S.tree_edges(_field(spark, d), 150)


@q("split_tree", "cc:l lower:l higher:l", f"WITH {SQL.tree(150, split=True)} SELECT * FROM te")
def _(spark, d):
    return S.tree_edges(_field(spark, d), 150, split=True)


@q("contour_tree", "cc:l lower:l higher:l")
def _(spark, d):
    return S.contour_tree(_field(spark, d), 150)


@q("critical_points", "idx:l up:l down:l kind:s", f"WITH {SQL.tree(150)}, {SQL.POINTS} SELECT * FROM kinds")
def _(spark, d):
    return S.critical_points(S.tree_edges(_field(spark, d), 150))


@q(
    "critical_edges", "lower:l higher:l",
    f"""WITH RECURSIVE {SQL.tree(150)}, {SQL.POINTS},
up(lower, higher) AS (SELECT lower, higher FROM te WHERE lower NOT IN (SELECT idx FROM kinds WHERE kind = 'regular') UNION ALL SELECT up.lower, te.higher FROM up JOIN te ON te.lower = up.higher WHERE up.higher IN (SELECT idx FROM kinds WHERE kind = 'regular'))
SELECT * FROM up WHERE higher NOT IN (SELECT idx FROM kinds WHERE kind = 'regular')""",
)
def _(spark, d):
    return S.critical_edges(S.tree_edges(_field(spark, d), 150))


@q("maxima_and_saddles", "idx:l kind:s", f"WITH {SQL.tree(150)}, {SQL.POINTS} SELECT idx, CASE WHEN up = 0 THEN 'max' ELSE 'saddle' END AS kind FROM kinds WHERE up <> 1")
def _(spark, d):
    return S.maxima_and_saddles(S.tree_edges(_field(spark, d), 150))


@q(
    "branch_components", "label:l component:l",
    f"""WITH RECURSIVE {SQL.tree(150)}, {SQL.POINTS}, link AS (SELECT lower, higher FROM te WHERE lower IN (SELECT idx FROM kinds WHERE up = 1)),
way(label, place) AS (SELECT idx, idx FROM kinds UNION ALL SELECT label, higher FROM way JOIN link ON link.lower = way.place),
tops AS (SELECT label, place FROM way WHERE place NOT IN (SELECT lower FROM link)) SELECT label, min(label) OVER (PARTITION BY place) AS component FROM tops""",
)
def _(spark, d):
    return S.branch_components(S.tree_edges(_field(spark, d), 150))


@q("region_merges", "persistence:d size:l top:d saddle:d", f"WITH {SQL.region_merges(130)} SELECT * FROM rm")
def _(spark, d):
    return S.region_merges(_field(spark, d), 130).replace(float("inf"), None, ["persistence"]).replace(float("-inf"), None, ["saddle"])


@q("persistence_plot", "persistence:d segments:l", f"WITH {SQL.region_merges(130)} {SQL.curve('rm', 400.0, 200, '>')}")
def _(spark, d):
    return S.persistence_plot(S.region_merges(_field(spark, d), 130), 400.0)


@q("persistence_plot_default", "persistence:d segments:l", f"WITH {SQL.ordered(130)}, {SQL.events(130, 5)} {SQL.curve('ev', 400.0, 10000, '>=')}")
def _(spark, d):
    return S.persistence_plot(S.merge_events(_field(spark, d), 130, S.Rule(min_size=5)), 400.0, 10_000, ties=True)


for _how, _sql in (("two", SQL.split_two(22)), ("standard", SQL.split_standard(22, 40.0)), ("spectral", None)):

    @q(f"split_{_how}", "idx:l label:l", _sql)
    def _(spark, d, how=_how):
        v = _field(spark, d).select("idx", "x", "y", "z", F.col("a").alias("label"), F.col("value").alias("distance"))
        return S.split_label(v, 22, how, persistence=40.0)


# ---------------------------------------------------------------- distances

for _plane in ("axes", "sphere", "normals"):
    for _how in ("one", "two", "average"):

        @q(f"distance_{_plane}_{_how}", "idx:l distance:d", SQL.in_plane(SIDE, _how) if _plane == "normals" else None)
        def _(spark, d, plane=_plane, how=_how):
            return D.distance_map(_with_normals(spark, d), G, how, plane, sphere=D.sphere_directions(SPHERE), label="a")


def _with_normals(spark, d):
    return vox(spark, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.6), "nz": F.lit(0.8)})


@q("distance_field", "idx:l distance:d", f"SELECT vox.idx, coalesce(m.distance, 0) AS distance FROM vox LEFT JOIN ({SQL.in_plane(SIDE, 'one')}) m USING (idx)")
def _(spark, d):
    v = _with_normals(spark, d)
    return D.distance_field(v, D.distance_map(v, G, "one", "normals", label="a"))


@q("ray_hits", "landmark_id:l ray:l x:d y:d z:d", SQL.landmark_rays(SIDE, D.sphere_directions(8)))
def _(spark, d):
    return D.ray_hits(marks(spark, d), vox(spark, d), G, D.sphere_directions(8), "a")


# ---------------------------------------------------------------- lines and display data

_SEG = """seg AS (
  SELECT line_id, point_idx AS seg, x, y, z, data, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(data) OVER w AS d1,
         lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(z) OVER w AS z0, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(z, 2) OVER w AS z2 FROM pts WINDOW w AS (PARTITION BY line_id ORDER BY point_idx)),
s AS (SELECT line_id, seg, x, y, z, x1, y1, z1, data, d1, coalesce(x0, 2*x-x1) AS prx, coalesce(y0, 2*y-y1) AS pry, coalesce(z0, 2*z-z1) AS prz, coalesce(x2, 2*x1-x) AS pox, coalesce(y2, 2*y1-y) AS poy, coalesce(z2, 2*z1-z) AS poz, x2 IS NOT NULL AS more FROM seg WHERE x1 IS NOT NULL)"""


@q("line_segments", "line_id:l seg:l prx:d pry:d prz:d x:d y:d z:d x1:d y1:d z1:d pox:d poy:d poz:d", f"WITH {_SEG} SELECT * FROM s")
def _(spark, d):
    s = LN.segments(pts(spark, d), "data", bend=None)
    return s.select("line_id", "seg", *[F.col(f"{p}.{c}").alias(n + c + e) for p, n, e in (("pre", "pr", ""), ("start", "", ""), ("end", "", "1"), ("post", "po", "")) for c in "xyz"])


@q(
    "line_bends", "line_id:l seg:l sphere:b",
    f"""WITH {_SEG} SELECT line_id, seg, more AND coalesce(acos(greatest(-1.0, least(1.0, ((pox-x1)*(x-x1) + (poy-y1)*(y-y1) + (poz-z1)*(z-z1))
  / nullif(sqrt((pox-x1)**2 + (poy-y1)**2 + (poz-z1)**2) * sqrt((x-x1)**2 + (y-y1)**2 + (z-z1)**2), 0)))) < 2.0, false) AS sphere FROM s""",
)
def _(spark, d):
    return LN.segments(pts(spark, d), "data", bend=2.0)


@q("line_endings", "line_id:l point_idx:l x:d y:d z:d", "SELECT line_id, point_idx, x, y, z FROM pts p WHERE point_idx = 0 OR point_idx = (SELECT max(point_idx) FROM pts q WHERE q.line_id = p.line_id)")
def _(spark, d):
    return LN.endings(pts(spark, d))


@q("line_nodes", "line_id:l point_idx:l radius:d color:d", "SELECT line_id, point_idx, abs(data - 15) AS radius, data AS color FROM pts")
def _(spark, d):
    return LN.nodes(pts(spark, d).withColumn("r", F.col("data") - 15), "r", "data").select("line_id", "point_idx", "radius", "color")


@q("line_bounding_box", "x_min:d x_max:d y_min:d y_max:d z_min:d z_max:d", "SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM (SELECT x, y, z FROM pts UNION ALL SELECT x, y, z FROM marks)")
def _(spark, d):
    return LN.bounding_box(pts(spark, d), marks(spark, d))


@q("display_box", "x_min:d x_max:d y_min:d y_max:d z_min:d z_max:d", "SELECT min(x)-2.5 AS x_min, max(x)+2.5 AS x_max, min(y)-2.5 AS y_min, max(y)+2.5 AS y_max, min(z)-2.5 AS z_min, max(z)+2.5 AS z_max FROM pts")
def _(spark, d):
    return LN.display_box(LN.bounding_box(pts(spark, d)), 2.5)


_VOLUME = f"""{_SEG}, g AS (SELECT greatest(abs(data), abs(d1)) AS big, least(abs(data), abs(d1)) AS small, sqrt((x1-x)**2 + (y1-y)**2 + (z1-z)**2) AS h FROM s),
vol AS (SELECT * FROM (SELECT sum(CASE WHEN big - small <= 1e-5 THEN big*big*h ELSE (big*big*(h*big/(big-small)) - small*small*(h*big/(big-small) - h)) / 3 END) AS tube_volume, max(big) AS max_tube FROM g),
  (SELECT sum(4.0/3.0*abs(data)**3) AS sphere_volume, max(abs(data)) AS max_sphere FROM pts))"""


@q("line_volumes", "tube:d max_tube:d sphere:d max_sphere:d", f"WITH {_VOLUME} SELECT tube_volume / 1e6 AS tube, max_tube, sphere_volume / 1e6 AS sphere, max_sphere FROM vol")
def _(spark, d):
    p = pts(spark, d)
    return LN.volumes(LN.segments(p, "data", None), p, "data").selectExpr("tube_volume / 1e6 as tube", "max_tube", "sphere_volume / 1e6 as sphere", "max_sphere")


@q(
    "radius_scales", "tube_max:d node_max:d ending_max:d tube:d node:d",
    f"""WITH {_VOLUME}, e AS (SELECT max(x)-min(x) AS dx, max(y)-min(y) AS dy, max(z)-min(z) AS dz FROM pts),
r AS (SELECT sqrt(0.2*room/(pi()*tube_volume)) AS t, (0.5*room/(pi()*sphere_volume))**(1.0/3) AS n FROM vol, (SELECT greatest(dx, 0.1*greatest(dx,dy,dz))**2 * greatest(dy, 0.1*greatest(dx,dy,dz)) AS room FROM e))
SELECT t AS tube_max, n AS node_max, 1.5*n AS ending_max, 0.25*t AS tube, 0.25*n AS node FROM r""",
)
def _(spark, d):
    p = pts(spark, d)
    return LN.radius_scales(LN.bounding_box(p), LN.volumes(LN.segments(p, "data", None), p, "data"))


@q("attribute_ranges", "attribute:s vmin:d vmax:d", "SELECT 'n' AS attribute, min(n) AS vmin, max(n) AS vmax FROM stats UNION ALL SELECT 'cx', min(cx), max(cx) FROM stats UNION ALL SELECT 'label', min(label), max(label) FROM stats")
def _(spark, d):
    return LN.attribute_ranges(stats(vox(spark, d)), "n", "cx", "label")


@q("line_data_ranges", "attribute:s vmin:d vmax:d", "SELECT 'data' AS attribute, min(data) AS vmin, max(data) AS vmax FROM pts")
def _(spark, d):
    return LN.attribute_ranges(pts(spark, d), "data")


@q("colormap_texel", "idx:l texel:d", "SELECT idx, CASE WHEN (v-50)/250 < 0 THEN 1/512.0 WHEN (v-50)/250 > 1 THEN 1-1/512.0 ELSE (1-3/256.0)*((v-50)/250) + 1.5/256 END AS texel FROM vox")
def _(spark, d):
    return vox(spark, d).select("idx", LN.colormap_texel(F.col("v"), F.lit(50.0), F.lit(300.0), 256).alias("texel"))


@q(
    "colormap_samples", "slot:l value:d r:l g:l b:l",
    """SELECT slot, value, CASE WHEN f <= 1 THEN 0 ELSE floor((f - 1) * 255) END AS r, floor(CASE WHEN f <= 1 THEN f ELSE 2 - f END * 255) AS g, CASE WHEN f < 1 THEN floor((1 - f) * 255) ELSE 0 END AS b
FROM (SELECT i AS slot, i - 1.0 AS value, greatest(0.0, least(2.0, (i - 1.0) / 253 * 2)) AS f FROM range(256) r(i))""",
)
def _(spark, d):
    ramp = spark.createDataFrame([(0, 0, 0, 255), (1, 0, 255, 0), (2, 255, 0, 0)], "idx int, r int, g int, b int")
    return LN.colormap_samples(ramp, 0.0, 253.0, 256)


@q("segment_color", "idx:l r:d g:d b:d", "SELECT idx, CASE WHEN a = 3 THEN 1.0 ELSE 0.2 END * (1-0.25) + x/24.0*0.25 AS r, CASE WHEN a = 3 THEN 0.0 ELSE 0.4 END * (1-0.25) + y/24.0*0.25 AS g, CASE WHEN a = 3 THEN 0.0 ELSE 0.6 END * (1-0.25) + z/24.0*0.25 AS b FROM vox")
def _(spark, d):
    rgb = LN.segment_color([F.lit(0.2), F.lit(0.4), F.lit(0.6)], [F.col(c) / 24.0 for c in "xyz"], F.lit(0.25), (F.col("a") == 3, F.lit(False)))
    return vox(spark, d).select("idx", *[c.alias(n) for c, n in zip(rgb, "rgb")])


@q("label_slots", "label:l slot:l", "SELECT DISTINCT a AS label, a + 1 AS slot FROM vox")
def _(spark, d):
    return LN.label_slots(vox(spark, d), "a")


@q(
    "color_source", "kind:s slot:l r:d g:d b:d",
    """SELECT 'none' AS kind, i AS slot, 0.9 AS r, 0.9 AS g, 0.9 AS b FROM range(256) r(i) UNION ALL SELECT 'constant', i, 0.2, 0.4, 0.6 FROM range(256) r(i)
UNION ALL SELECT 'labels', a + 1, min(idx) % 256 / 255.0, min(idx) % 128 / 127.0, min(idx) % 64 / 63.0 FROM vox GROUP BY a UNION ALL SELECT 'labels', 254, 0.1, 0.1, 0.1""",
)
def _(spark, d):
    part = lambda n: (F.col("idx") % n / (n - 1))
    colors = vox(spark, d).select("idx", F.col("a").alias("label"), part(256).alias("r"), part(128).alias("g"), part(64).alias("b"))
    sources = {"none": {}, "constant": {"rgb": (0.2, 0.4, 0.6)}, "labels": {"labels": colors, "order": "idx"}}
    none, constant, labels = (LN.color_source(spark, **s).withColumn("kind", F.lit(k)) for k, s in sources.items())
    return none.unionByName(constant).unionByName(labels)


@q("toggle_selection", "vertex_id:l ord:l", "SELECT label AS vertex_id, n AS ord FROM stats WHERE label <> 7 UNION ALL SELECT 900, max(n) + 1 FROM stats WHERE label <> 7")
def _(spark, d):
    s = stats(vox(spark, d)).select(F.col("label").cast("long").alias("vertex_id"), F.col("n").alias("ord"))
    return LN.toggle_selection(LN.toggle_selection(s, 7, True), 900, True)


@q("pick_vertices", "label:l distance:d", "SELECT label, t - sqrt(9 - o) AS distance FROM (SELECT label, cx AS t, (cy - 12.75)**2 + (cz - 17)**2 AS o FROM stats) WHERE o <= 9 AND t >= 0")
def _(spark, d):
    s = stats(vox(spark, d)).select("label", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), F.lit(3.0).alias("radius"))
    return LN.pick(s, (0.0, 12.75, 17.0), (2.0, 0.0, 0.0), "label")

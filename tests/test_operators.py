"""Hand-worked cases, and brute-force comparisons on small volumes."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.functions import lattice as LF
from latticework.operators import distance as D
from latticework.operators import labels as LB
from latticework.operators import lines as LN
from latticework.operators import metrics as M
from latticework.operators import neighborhood as N
from latticework.operators import regions as R
from latticework.operators import segmentation as S
from latticework.sources import volumes as V


def volume(spark, dims, **fields):
    nx, ny, nz = dims
    rows = [((z * ny + y) * nx + x, x, y, z, *(f[(z * ny + y) * nx + x] for f in fields.values())) for z in range(nz) for y in range(ny) for x in range(nx)]
    kind = lambda v: "double" if isinstance(v, float) else "int"
    return spark.createDataFrame(rows, "idx long, x int, y int, z int" + "".join(f", {n} {kind(f[0])}" for n, f in fields.items()))


def column(df, c, by="idx"):
    return [r[c] for r in df.orderBy(by).collect()]


def test_partition_metrics_by_hand(spark):
    v = volume(spark, (4, 1, 1), seg=[1, 1, 2, 2], gt=[1, 1, 1, 2], mask=[1, 1, 1, 1])
    t = M.contingency(v, "seg", "gt", F.col("mask") != 0)
    assert M.variation_of_information(t).first().vi == pytest.approx(0.823959, abs=1e-6)
    assert M.rand_index(t).first().rand_index == pytest.approx(0.5)
    assert M.dice(v, "seg", "gt").first().dice == 1.0


def test_metrics_of_equal_and_empty_fields(spark):
    v = volume(spark, (4, 1, 1), a=[1, 1, 2, 0], mask=[1, 1, 1, 1])
    t = M.contingency(v, "a", "a", F.col("mask") != 0)
    assert M.variation_of_information(t).first().vi == pytest.approx(0)
    assert M.rand_index(t).first().rand_index == 1.0
    assert M.dice(v.withColumn("b", F.lit(0)), "b", "b").first().dice is None


def test_rand_index_is_that_of_all_pairs(spark):
    r = random.Random(1)
    a, b = [r.randrange(4) for _ in range(60)], [r.randrange(3) for _ in range(60)]
    same = sum((a[i] == a[j]) == (b[i] == b[j]) for i in range(60) for j in range(60) if i != j)
    v = volume(spark, (60, 1, 1), a=a, b=b)
    assert M.rand_index(M.contingency(v, "a", "b", F.lit(True))).first().rand_index == pytest.approx(same / (60 * 59))


def test_box_mean(spark):
    v = volume(spark, (3, 1, 1), label=[1, 1, 0], value=[2.0, 4.0, 9.0])
    assert column(N.box_mean(v, 1), "mean") == [3.0, 3.0, 0.0]
    r = np.random.RandomState(0)
    lab, val = r.randint(0, 2, (4, 5, 6)), r.randint(0, 9, (4, 5, 6)).astype(float)
    v = volume(spark, (6, 5, 4), label=lab.ravel().tolist(), value=val.ravel().tolist())
    got = column(N.box_mean(v, 1), "mean")
    for z in range(4):
        for y in range(5):
            for x in range(6):
                s = np.s_[max(0, z - 1) : z + 2, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
                want = val[s][lab[s] > 0].mean() if lab[z, y, x] else 0
                assert got[(z * 5 + y) * 6 + x] == pytest.approx(want)


def test_adjacency_skips_first_planes(spark):
    assert R.adjacency(volume(spark, (2, 1, 1), label=[1, 2])).count() == 0
    assert R.adjacency(volume(spark, (2, 1, 1), label=[1, 2]), skip_first_planes=False).collect() == [(1, 2)]
    assert R.adjacency(volume(spark, (2, 2, 2), label=[1, 2] * 4)).collect() == [(1, 2)]


def test_neighborhood_sizes():
    assert [len(LF.offsets(k)) for k in (6, 14, 18, 26)] == [6, 14, 18, 26]
    assert [len(LF.forward(k)) for k in ("6", "18", "26", "corners26")] == [3, 9, 13, 7]
    assert {tuple(-x for x in o) for o in LF.forward("26")} | set(LF.forward("26")) == set(LF.OFFSETS)


def test_landmarks_by_hand(spark):
    v = volume(spark, (3, 1, 1), label=[1, 0, 2])
    p = spark.createDataFrame([(1, 0.2, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, 0.9, 0.0, 0.0)], "landmark_id long, x double, y double, z double")
    hits = M.landmark_labels(p, v, V.Geometry((3, 1, 1)))
    assert column(hits, "label", "landmark_id") == [1, 0, 2]
    found = M.landmark_labels_search(p, v, V.Geometry((3, 1, 1)))
    assert column(found, "label", "landmark_id") == [1, 2, 2]


def test_landmark_summary(spark):
    hits = spark.createDataFrame([(1, 1), (2, 0), (3, 2)], "landmark_id long, label long")
    s = M.landmark_summary(M.landmark_table(hits, 2)).first()
    assert (s.correct, s.background, s.precision, s.recall) == (2, 1, 1.0, pytest.approx(2 / 3))


def test_segmentation_by_hand(spark):
    v = volume(spark, (7, 1, 1), value=[0.0, 5.0, 1.0, 4.0, 0.0, 3.0, 0.0])
    seg = lambda p, o: column(S.segment(v, 1.0, S.Rule(persistence=p, order=o)), "label")
    assert seg(2.0, "majority") == [0, 1, 2, 2, 0, 3, 0]
    assert seg(2.0, "value") == [0, 1, 1, 2, 0, 3, 0]
    assert seg(3.0, "majority") == seg(3.0, "value") == [0, 1, 1, 1, 0, 2, 0]


def plain_sweep(values, dims, threshold, rule):
    """One pass over the whole volume, without components."""
    nx, ny, nz = dims
    order = sorted((i for i in range(len(values)) if values[i] >= threshold), key=lambda i: (-values[i], -i))
    parent, top, size = {}, {}, {}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in order:
        parent[i], top[i], size[i] = i, values[i], 1
        x, y, z = i % nx, i // nx % ny, i // (nx * ny)
        near = []
        for a, b, c in LF.OFFSETS:
            if 0 <= x + a < nx and 0 <= y + b < ny and 0 <= z + c < nz:
                j = ((z + c) * ny + y + b) * nx + x + a
                if j in parent:
                    near.append(j)
        roots = [find(j) for j in near]
        near = sorted(near, key=lambda j: -values[j]) if rule.order == "value" else [j for j, r in sorted(zip(near, roots), key=lambda p: -roots.count(p[1]))]
        for j in near:
            a, b = find(i), find(j)
            low = lambda k: (top[k] - values[i]) / (top[k] - min(values)) if rule.mode == "adaptive" else top[k] - values[i]  # noqa: E731,B023
            if a != b and (low(a) <= rule.persistence or size[a] < rule.min_size or low(b) <= rule.persistence or size[b] < rule.min_size):
                parent[a] = b
                top[b], size[b] = max(top[a], top[b]), size[a] + size[b]
    names = {}
    return [names.setdefault(find(i), len(names) + 1) if i in parent else 0 for i in range(len(values))]


@pytest.mark.parametrize("rule", [S.Rule(2.0, order="value"), S.Rule(1.0, min_size=4), S.Rule(0.3, mode="adaptive")])
def test_segmentation_is_that_of_one_sweep(spark, rule):
    r = np.random.RandomState(7)
    values = (r.permutation(216) / 20.0).tolist()
    v = volume(spark, (6, 6, 6), value=values)
    assert column(S.segment(v, 6.5, rule), "label") == plain_sweep(values, (6, 6, 6), 6.5, rule)


@pytest.mark.parametrize("brick", [2, 3, 64])
def test_components_over_bricks(spark, brick):
    values = np.random.RandomState(11).rand(7 * 6 * 5).tolist()
    v = volume(spark, (7, 6, 5), value=values)
    own = {i for i, x in enumerate(values) if x >= 0.9}
    beside = lambda i, j: max(abs(i % 7 - j % 7), abs(i // 7 % 6 - j // 7 % 6), abs(i // 42 - j // 42)) <= 1
    want = {}
    for seed in sorted(own):
        todo = [seed] if seed not in want else []
        while todo:
            i = todo.pop()
            if i not in want:
                want[i] = seed
                todo += [j for j in own if beside(i, j)]
    got = {r.idx: r.cc for r in S.superlevel_components(v, 0.9, brick=brick).collect()}
    assert got == want and len(set(want.values())) > 3


def test_persistence_follows_a_new_range():
    share = S.remembered_persistence(5.0, 100.0, "absolute")
    assert S.reapplied_persistence(share, 40.0, "absolute") == 2.0
    assert S.remembered_persistence(0.2, 100.0, "adaptive") == S.reapplied_persistence(0.2, 7.0, "relative") == 0.2


def test_region_merges_count_the_segments(spark):
    r = np.random.RandomState(3)
    values = (r.permutation(125) / 10.0).tolist()
    v = volume(spark, (5, 5, 5), value=values)
    merges = S.region_merges(v, 5.0)
    for p in (0.0, 1.5, 4.0):
        assert merges.where(F.col("persistence") > p).count() == len(set(plain_sweep(values, (5, 5, 5), 5.0, S.Rule(p, order="value"))) - {0})


def test_trees_span_their_components(spark):
    v = volume(spark, (7, 1, 1), value=[1.0, 5.0, 1.5, 4.0, 2.0, 3.0, 0.5])
    edges = {(r.lower, r.higher) for r in S.tree_edges(v, 0.0).collect()}
    assert edges == {(2, 1), (4, 3), (4, 5), (2, 4), (0, 2), (6, 0)}
    kinds = {r.idx: r.kind for r in S.critical_points(S.tree_edges(v, 0.0)).collect()}
    assert [kinds[i] for i in range(7)] == ["regular", "max", "saddle", "max", "saddle", "max", "min"]
    assert {(r.lower, r.higher) for r in S.critical_edges(S.tree_edges(v, 0.0)).collect()} == {(2, 1), (4, 3), (4, 5), (2, 4), (6, 2)}
    assert {(r.lower, r.higher) for r in S.contour_tree(v, 0.0).collect()} == {(0, 1), (2, 1), (2, 3), (4, 3), (4, 5), (6, 5)}


def test_contour_tree_has_the_join_and_split_tree_of_its_field(spark):
    """Which no other tree on the same points has."""
    values = (np.random.RandomState(6).permutation(80) / 7.0).tolist()
    v = volume(spark, (5, 4, 4), value=values)
    pairs = lambda df: {(r.lower, r.higher) for r in df.collect()}
    contour = pairs(S.contour_tree(v, 0.0))
    near = {i: set() for i in range(80)}
    for a, b in contour:
        near[a].add(b)
        near[b].add(a)
        assert values[a] < values[b]

    def swept(order):
        tip, out = {}, set()
        for i in order:
            for c in {tip[j] for j in near[i] if j in tip}:
                out.add((i, c))
                tip = {j: i if t == c else t for j, t in tip.items()}
            tip[i] = i
        return out

    down = sorted(range(80), key=lambda i: -values[i])
    assert len(contour) == 79
    assert swept(down) == pairs(S.tree_edges(v, 0.0))
    assert {(b, a) for a, b in swept(down[::-1])} == pairs(S.tree_edges(v, 0.0, split=True))


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    label = list(range(60))
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = R.connected_components(spark.range(60).withColumnRenamed("id", "label"), spark.createDataFrame(edges, "src long, dst long"))
    assert column(got, "component", "label") == label


def test_clean_and_first_seen(spark):
    v = volume(spark, (4, 1, 1), label=[4, 1, 0, 3])
    assert {r.label: r.target for r in LB.clean_mapping(v).collect()} == {1: 1, 3: 2, 4: 3}
    assert {r.label_: r.label for r in LB.first_seen_mapping(v.where("label > 0").withColumnRenamed("label", "label_"), "label_").collect()} == {4: 1, 1: 2, 3: 3}


def test_meld_critical_uses_sizes_as_they_grow(spark):
    stats = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (2, 5, 0.0, 0.0, 0.0), (3, 2, 0.0, 0.0, 0.0), (4, 5, 0.0, 0.0, 0.0), (9, 1, 0.0, 0.0, 0.0)], "label int, n long, cx double, cy double, cz double")
    edges = spark.createDataFrame([(1, 4), (2, 3), (3, 4)], "src int, dst int")
    got = R.meld_critical(spark.createDataFrame([(1,), (3,), (9,)], "label int"), stats, edges)
    assert {r.label: r.target for r in got.collect()} == {1: 4, 3: 4, 9: 0}


def test_colors_differ_between_neighbors(spark):
    edges = [(a, b) for a in range(1, 8) for b in range(a + 1, 8) if (a * b) % 3]
    stats = spark.createDataFrame([(x,) for x in range(1, 8)], "label long")
    color = {r.label: r.color for r in R.color_regions(stats, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(color[a] != color[b] for a, b in edges)


@pytest.mark.parametrize("how", ["two", "standard", "spectral"])
def test_split_of_two_hills(spark, how):
    hill = [5.0, 6.0, 5.5, 1.0, 4.0, 6.5, 4.5]
    v = volume(spark, (7, 1, 1), label=[3] * 7, distance=hill)
    got = column(S.split_label(v, 3, how, persistence=1.0), "label")
    assert got[5] == 3 or how == "spectral"
    assert len(set(got)) == 2 and got[0] == got[1] == got[2] and got[4] == got[5] == got[6] and got[0] != got[6]


def bits_of(fore):
    return np.packbits(fore.ravel(), bitorder="little")


def plain_march(fore, start, direction):
    """One ray, step by step, through voxels of size 1; distance and place."""
    major = int(np.argmax(np.abs(direction)))
    if not direction[major]:
        return D.MISS, None
    step = direction / abs(direction[major])
    base = math.floor(start[major])
    first = start + step * ((base - start[major]) * np.sign(direction[major]))
    first[major] = base
    for k in range(1, 100):
        cell = np.floor(first + k * step + 0.5).astype(int)
        if (cell < 0).any() or (cell >= fore.shape[::-1]).any():
            return D.MISS, None
        if not fore[cell[2], cell[1], cell[0]]:
            return float(np.linalg.norm(cell - first)), cell.astype(float)


def test_ray_march():
    fore = np.ones((5, 5, 9), bool)
    fore[:, :, 7] = False
    g, middle = V.Geometry((9, 5, 5)), np.full((3, 3), 2.0)
    distance, where = D.march(bits_of(fore), g, middle, np.array([[1.0, 0, 0], [-1.0, 0, 0], [0, 0, 0]]))
    assert distance.tolist() == [5.0, D.MISS, D.MISS] and where[0].tolist() == [7, 2, 2] and np.isnan(where[1:]).all()
    assert np.allclose(D.plane_by_hits(np.array([[0, 0, 1.0], [1, 0, 1], [0, 1, 1], [3, 2, 1]])) ** 2, [0, 0, 1])
    r = np.random.default_rng(5)
    fore = r.random((6, 5, 7)) < 0.7
    start, way = r.random((400, 3)) * [7, 5, 6], r.normal(size=(400, 3))
    distance, where = D.march(bits_of(fore), V.Geometry((7, 5, 6)), start, way)
    for d, p, a, b in zip(distance, where, start, way):
        want = plain_march(fore, a, b)
        assert d == pytest.approx(want[0]) and (want[1] is None and np.isnan(p).all() or (p == want[1]).all())


def plain_plane(fore, at, plane, size, sphere):
    if plane == "normals":
        return np.array([0, 0.6, 0.8])
    if plane == "sphere":
        hits = [p for p in (plain_march(fore, np.array(at, float), s)[1] for s in sphere) if p is not None]
        return np.linalg.svd(np.array(hits) - np.mean(hits, 0), full_matrices=False)[2][-1] if len(hits) > 2 else np.zeros(3)  # the same sign: many rays end on edges
    cube = lambda r: np.array([(x, y, z) for z, y, x in np.argwhere(fore) if max(abs(x - at[0]), abs(y - at[1]), abs(z - at[2])) <= r], float)
    own = cube(size)
    if len(own) < 3:
        return np.zeros(3)
    own = own - cube(20).mean(0)
    return np.linalg.eigh(own.T @ own)[1][:, 0]


@pytest.mark.parametrize("plane", ["axes", "sphere", "normals"])
@pytest.mark.parametrize("how", ["one", "two", "average"])
def test_distance_map_is_brute_force(spark, how, plane, monkeypatch):
    monkeypatch.setattr(D, "RAYS_AT_ONCE", 100)
    r = np.random.default_rng(3)
    fore = r.random((6, 5, 7)) < 0.8
    g, sphere = V.Geometry((7, 5, 6)), D.sphere_directions(20)
    v = volume(spark, (7, 5, 6), label=[int(x) for x in fore.ravel()]).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.6), "nz": F.lit(0.8)})
    want = {}
    for z, y, x in np.argwhere(fore):
        n = plain_plane(fore, (x, y, z), plane, 2, sphere)
        if not n.any():
            want[(z * 5 + y) * 7 + x] = D.MISS
            continue
        u = D.orthogonal(n[None])[0]
        w = np.cross(n, u)
        ray = lambda a: plain_march(fore, np.array([x, y, z], float), math.cos(a) * u + math.sin(a) * w)[0]  # noqa: E731,B023
        turn = [2 * math.pi * k / 12 for k in range(13)]
        hits = [d for d in map(ray, turn) if d < D.MISS]
        half = [math.pi * k / 12 for k in range(12)]
        want[(z * 5 + y) * 7 + x] = {"one": min(map(ray, turn)), "two": min(ray(a) + ray(a + math.pi) for a in half), "average": sum(hits) / len(hits) if hits else 0.0}[how]
    got = {x.idx: x.distance for x in D.distance_map(v, g, how, plane, rays=13, size=2, sphere=sphere).collect()}
    off = [i for i in want if abs(got[i] - want[i]) > 1e-6]
    assert got.keys() == want.keys() and len(off) <= (0 if plane == "normals" else 4)  # a ray through an edge may fall either way


def test_distance_maps_check_their_inputs(spark):
    v = volume(spark, (2, 1, 1), label=[1, 0])
    for wrong in ({"how": "three"}, {"plane": "none"}, {"plane": "sphere"}, {"plane": "normals"}):
        with pytest.raises(ValueError):
            D.distance_map(v, V.Geometry((2, 1, 1)), **wrong)


def test_distance_field_is_zero_outside(spark):
    v = volume(spark, (3, 1, 1), label=[1, 0, 1])
    m = spark.createDataFrame([(0, 2.5)], "idx long, distance double")
    assert column(D.distance_field(v, m), "distance") == [2.5, 0.0, 0.0]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_dilation_is_that_of_all_voxels(spark, radius):
    r = np.random.RandomState(4)
    label = (r.randint(0, 4, (6, 7, 8)) * (r.rand(6, 7, 8) < 0.3)).astype(int)
    label[2:4, 2:5, 2:6] = 3
    got = {(x.label, x.idx) for x in N.dilation_ring(volume(spark, (8, 7, 6), label=label.ravel().tolist()), radius).collect()}
    cells = [(z, y, x) for z in range(6) for y in range(7) for x in range(8)]
    want = {(int(label[p]), (q[0] * 7 + q[1]) * 8 + q[2]) for p in cells if label[p] for q in cells if not label[q] and sum((a - b) ** 2 for a, b in zip(p, q)) <= radius * radius}
    assert got == want


@pytest.mark.parametrize("mode", ["absolute", "adaptive"])
def test_fast_segmentation_is_the_sweep_by_value(spark, mode):
    for seed in (1, 2, 3):
        values = (np.random.RandomState(seed).permutation(216) / 20.0).tolist()
        v = volume(spark, (6, 6, 6), value=values)
        for p in (0.0, 0.15, 0.4, 2.0):
            rule = S.Rule(p, order="value", mode=mode)
            assert column(S.segment_fast(v, 5.0, rule), "label") == plain_sweep(values, (6, 6, 6), 5.0, rule)
    assert set(column(S.segment_fast(v, 99.0, rule), "label")) == {0}


def test_sweep_is_one_segmentation_for_each_persistence(spark):
    values = (np.random.RandomState(8).permutation(125) / 10.0).tolist()
    v = volume(spark, (5, 5, 5), value=values)
    got = S.persistence_sweep(v, 5.0, 1, 3, 1, min_size=3)
    for p in (1.0, 2.0, 3.0):
        assert column(got.where(F.col("persistence") == p), "label") == plain_sweep(values, (5, 5, 5), 5.0, S.Rule(p, min_size=3))


@pytest.mark.parametrize("mode", ["absolute", "adaptive"])
def test_default_plot_counts_segments_without_a_minimum_size(spark, mode):
    values = (np.random.RandomState(9).permutation(125) / 10.0).tolist()
    v = volume(spark, (5, 5, 5), value=values)
    curve = S.persistence_plot(S.merge_events(v, 5.0, S.Rule(order="value", mode=mode)), 0.98765 if mode == "adaptive" else 4.98765, 41, ties=True)  # no sample where a region ends
    for r in curve.collect():
        want = len(set(plain_sweep(values, (5, 5, 5), 5.0, S.Rule(max(0.0, r.persistence - 1e-9), order="value", mode=mode))) - {0})
        assert r.segments == want


def test_default_plot_takes_small_regions_out(spark):
    # 9 and 7 meet at 4, both of two voxels; 8 of one joins at 3
    v = volume(spark, (7, 1, 1), value=[8.0, 3.0, 9.0, 6.0, 4.0, 7.0, 5.0])
    lasting = lambda n: sorted(r.persistence for r in S.merge_events(v, 1.0, S.Rule(min_size=n, order="value")).collect())
    assert lasting(0) == [3.0, 5.0, math.inf] and lasting(2) == [3.0, math.inf] and lasting(4) == [math.inf]


def test_improved_colors_differ_between_neighbors(spark):
    edges = [(a, b) for a in range(1, 9) for b in range(a + 1, 9) if (a + b) % 3]
    colors = spark.createDataFrame([(x, 0.5, 0.5, 0.1 * (x % 2)) for x in range(1, 10)], "label long, r double, g double, b double")
    got = {x.label: (x.r, x.g, x.b) for x in R.improve_colors(colors, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(got) == 9 and all(math.dist(got[a], got[b]) >= 0.5 for a, b in edges)
    assert got[1] == (0.5, 0.5, 0.1) and got[9] == (0.5, 0.5, 0.1)


def test_color_sources(spark):
    labels = spark.createDataFrame([(1, 5, 0.1, 0.2, 0.3), (0, 5, 0.4, 0.5, 0.6), (2, 253, 1.0, 1.0, 1.0), (3, -1, 1.0, 1.0, 1.0)], "ord int, label int, r double, g double, b double")
    assert sorted(tuple(r) for r in LN.color_source(spark, labels=labels, order="ord").collect()) == [(6, 0.4, 0.5, 0.6), (254, 0.1, 0.1, 0.1)]
    assert {tuple(r)[1:] for r in LN.color_source(spark).collect()} == {(0.9, 0.9, 0.9)} and LN.color_source(spark, rgb=(1, 0, 0)).count() == 256
    ramp = spark.createDataFrame([(0, 0, 0, 255), (1, 255, 0, 0)], "idx int, r int, g int, b int")
    assert LN.color_source(spark, colormap=ramp).columns == ["slot", "r", "g", "b"]


def test_unfinished_components_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    with pytest.raises(RuntimeError):
        R.connected_components(spark.range(31).withColumnRenamed("id", "label"), path, rounds=1)


@pytest.mark.parametrize("plane", ["axes", "sphere", "normals"])
def test_distance_queries_take_the_whole_volume(spark, sf_dir, plane):
    from latticework.plans import catalog, registry

    whole = {x.idx for x in catalog.vox(spark, sf_dir).where("a > 0").select("idx").collect()}
    assert {x.idx for x in registry.QUERIES[f"distance_{plane}_one"](spark, sf_dir).collect()} == whole


def test_distance_needs_a_plane(spark):
    v = volume(spark, (3, 3, 3), label=[1] * 27).withColumns({c: F.lit(0.0) for c in ("nx", "ny", "nz")})
    assert set(column(D.distance_map(v, V.Geometry((3, 3, 3)), plane="normals", rays=5), "distance")) == {D.MISS}


def test_ranges_of_line_data(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 1.0, 3.0), (0, 1, 0.0, 0.0, 2.0, 2.0, 4.0)], "line_id int, point_idx int, x double, y double, z double, d0 double, d1 double")
    assert [tuple(r) for r in LN.attribute_ranges(p, "d0", "d1").collect()] == [("d0", 1.0, 2.0), ("d1", 3.0, 4.0)]


def test_ranges_of_graph_attributes(spark):
    g = spark.createDataFrame([(1, 4, 8.0), (2, 5, 9.0)], "a int, b int, c float")
    assert [tuple(r)[1:] for r in LN.attribute_ranges(g, "a", "b", "c").collect()] == [(1, 2), (4, 5), (8, 9)]
    assert LN.eligible_attributes(g, "radius", labels=("a",)) == ["b", "c"]


def test_segments_mirror_at_ends(spark):
    p = spark.createDataFrame([(0, i, float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 3))] + [(1, 0, 0.0, 0.0, 0.0)], "line_id int, point_idx int, x double, y double, z double")
    s = LN.segments(p).orderBy("seg").collect()
    assert [(r.pre.x, r.start.x, r.end.x, r.post.x, r.sphere) for r in s] == [(-1, 0, 1, 3, False), (0, 1, 3, 5, False)]
    assert LN.endings(p).count() == 3


def test_volume_of_cylinder_and_sphere(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 0.0, 0.0, 2.0)], "line_id int, point_idx int, x double, y double, z double")
    v = LN.volumes(LN.segments(p), p).first()
    assert (v.tube_volume, v.max_tube, v.sphere_volume) == (2.0, 1.0, pytest.approx(8 / 3))


def test_selection_keeps_click_order(spark):
    s = spark.createDataFrame([(4, 0), (2, 1)], "vertex_id long, ord long")
    ids = lambda t: [r.vertex_id for r in t.orderBy("ord").collect()]
    assert ids(LN.toggle_selection(s, 7, True)) == [4, 2, 7]
    assert ids(LN.toggle_selection(s, 4, True)) == [2]
    assert ids(LN.toggle_selection(s, 7, False)) == [7]


def test_global_rank_and_cast(spark):
    d = spark.createDataFrame([(x % 7, x) for x in range(50)], "v int, idx int")
    got = [r["rank"] for r in LB.global_rank(d, F.desc("v"), F.desc("idx")).orderBy(F.desc("v"), F.desc("idx")).collect()]
    assert got == list(range(50))
    with pytest.raises(Exception, match="label out of range"):
        V.cast_labels(spark.createDataFrame([(70000,)], "label int")).collect()
    with pytest.raises(ValueError, match="missing"):
        V.require(d, w="integer")


def test_writers_and_readers(spark, tmp_path):
    t = spark.createDataFrame([(1, 0.5)], "label int, mean double")
    V.write_spreadsheet(t, f"{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").first().label == "1"
    V.write_label_fields(t.withColumnRenamed("mean", "persistence"), f"{tmp_path}/f")
    assert V.load_directory(spark, f"{tmp_path}/f").first().volume_id.endswith(".parquet")
    V.write_selection(spark.createDataFrame([(5, 1), (3, 0)], "vertex_id long, ord long"), f"{tmp_path}/sel")
    assert [r.vertex_id for r in V.read_selection(spark, f"{tmp_path}/sel").collect()] == [3, 5]


def test_robust_range_is_within_the_full_one(spark):
    v = volume(spark, (100, 1, 1), value=[float(i) for i in range(100)])
    full, robust = LB.robust_range(v, low=0.0, high=1.0).first(), LB.robust_range(v).first()
    assert full.vmin == 0 and full.vmax == 99 and 3 < robust.vmin < 6 and 93 < robust.vmax < 97
    assert math.isclose(pd.DataFrame(LB.histogram(v).collect())[1].sum(), 100)

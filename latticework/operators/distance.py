"""In-plane distances to the background: planes by principal axes, rays or given normals; ray marching.

A task marches rays through a packed copy of the segmentation, a bit per voxel, in the driver and
in workers; it is broadcast only up to a stated size, beyond which the call fails. All rays of many
voxels march at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.sources.volumes import Geometry

MISS = 100000.0
MOST_BYTES = 256_000_000
RAYS_AT_ONCE = 200_000
_BUCKET = 32_768


def packed(voxels: DataFrame, g: Geometry, label: str = "label") -> np.ndarray:
    """Foreground as bits in idx order, lowest bit first; fails for volumes over MOST_BYTES."""
    if g.size // 8 > MOST_BYTES:
        raise ValueError(f"{g.size} voxels are too many to broadcast")
    bits = np.zeros(-(-g.size // _BUCKET) * _BUCKET // 8, np.uint8)
    place = F.col("idx") + 1  # Spark's buckets begin at 1
    words = voxels.where(F.col(label) > 0).groupBy(F.bitmap_bucket_number(place).alias("w")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    for r in words.toLocalIterator():  # a row per 32,768 voxels
        at = (r.w - 1) * _BUCKET // 8
        bits[at : at + len(r.m)] = np.frombuffer(r.m, np.uint8)
    return bits


def inside(bits: np.ndarray, g: Geometry, cell: np.ndarray) -> np.ndarray:
    """Which cells (..., 3) of the grid are foreground."""
    i = (cell[..., 2] * g.dims[1] + cell[..., 1]) * g.dims[0] + cell[..., 0]
    return (bits[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)


def march(bits: np.ndarray, g: Geometry, start: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from points (n, 3) along directions (n, 3) to the first background voxel, and where it is.

    One step per voxel along the longest axis; the x voxel size counts for all axes. MISS and nan
    if the grid ends first, or for a zero direction.
    """
    h, o, dims = g.voxel[0], np.array(g.origin), np.array(g.dims)
    ray = np.arange(len(directions))
    major = np.argmax(np.abs(directions), 1)
    lead = directions[ray, major]
    rows = np.flatnonzero(lead)
    step = directions / np.where(lead == 0, 1, np.abs(lead))[:, None]
    p = (start - o) / h
    base = np.floor(p[ray, major])
    first = p + step * ((base - p[ray, major]) * np.sign(lead))[:, None]
    first[ray, major] = base
    distance, where = np.full(len(directions), MISS), np.full((len(directions), 3), np.nan)
    k = 0
    while len(rows):
        k += 1
        cell = np.floor(first[rows] + k * step[rows] + 0.5).astype(np.int64)
        still = ((cell >= 0) & (cell < dims)).all(1)
        rows, cell = rows[still], cell[still]
        ends = ~inside(bits, g, cell)
        there, cell = rows[ends], cell[ends]
        distance[there] = np.sqrt((((cell - first[there]) * h) ** 2).sum(1))
        where[there] = o + cell * h
        rows = rows[~ends]
    return distance, where


def orthogonal(n: np.ndarray) -> np.ndarray:
    """Unit vectors (m, 3) across vectors (m, 3); zero for zero."""
    out = np.zeros_like(n)
    for k in (2, 1, 0):  # the first component that isn't small decides
        big = np.abs(n[:, k]) > 1e-4
        out[big] = 0
        out[big, k], out[big, (k + 1) % 3] = -n[big, (k + 1) % 3], n[big, k]
    return out / np.maximum(np.sqrt((out * out).sum(1)), 1e-300)[:, None]


def plane_by_hits(points: np.ndarray) -> np.ndarray:
    """Normal of the least-squares plane; zero for under three points."""
    if len(points) < 3:
        return np.zeros(3)
    return np.linalg.svd(points - points.mean(0), full_matrices=False)[2][-1]


def _moments(bits: np.ndarray, g: Geometry, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Running sums over the box [lo, hi) of the foreground's 1, x, y, z, xx, xy, xz, yy, yz, zz (about lo)."""
    z, y, x = np.meshgrid(*(np.arange(hi[k] - lo[k]) for k in (2, 1, 0)), indexing="ij")
    fore = inside(bits, g, np.stack([x, y, z], -1) + lo).astype(np.int64)
    table = np.zeros((10, *(np.array(fore.shape) + 1)), np.int64)
    for t, f in zip(table, (1, x, y, z, x * x, x * y, x * z, y * y, y * z, z * z)):
        t[1:, 1:, 1:] = (fore * f).cumsum(0).cumsum(1).cumsum(2)
    return table


def _in_cubes(table: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums (10, m) over cubes of +-size around places (m, 3) of the box."""
    top = np.array(table.shape[:0:-1]) - 1
    lo, hi = np.clip(at - size, 0, top), np.clip(at + size + 1, 0, top)
    pick = lambda x, y, z: table[:, z, y, x]
    (a, b, c), (d, e, f) = lo.T, hi.T
    return pick(d, e, f) - pick(a, e, f) - pick(d, b, f) - pick(d, e, c) + pick(a, b, f) + pick(a, e, c) + pick(d, b, c) - pick(a, b, c)


def planes_by_axes(bits: np.ndarray, g: Geometry, at: np.ndarray, size: int, center_size: int = 20) -> np.ndarray:
    """Third principal axes of the foreground in cubes around places (m, 3), about the means of cubes of fixed size;
    zero for under three voxels."""
    reach = max(size, center_size)
    lo, hi = np.maximum(at.min(0) - reach, 0), np.minimum(at.max(0) + reach + 1, np.array(g.dims))
    table = _moments(bits, g, lo, hi)
    s, c = _in_cubes(table, at - lo, size).astype(float), _in_cubes(table, at - lo, center_size).astype(float)
    n, mean = s[0], (c[1:4] / np.maximum(c[0], 1)).T
    second = np.stack([s[4], s[5], s[6], s[5], s[7], s[8], s[6], s[8], s[9]], 1).reshape(-1, 3, 3)
    cross = s[1:4].T[:, :, None] * mean[:, None, :]
    spread = second - cross - cross.transpose(0, 2, 1) + n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    out = np.linalg.eigh(spread)[1][:, :, 0]
    out[n < 3] = 0
    return out


def check_inputs(voxels: DataFrame, how: str, plane: str, sphere: np.ndarray | None) -> None:
    """What a distance map needs before anything runs."""
    if how not in ("one", "two", "average"):
        raise ValueError("how is 'one', 'two' or 'average'")
    if plane not in ("axes", "sphere", "normals"):
        raise ValueError("plane is 'axes', 'sphere' or 'normals'")
    if plane == "sphere" and (sphere is None or not len(sphere)):
        raise ValueError("plane 'sphere' needs directions")
    if plane == "normals" and not {"nx", "ny", "nz"} <= set(voxels.columns):
        raise ValueError("plane 'normals' needs the columns nx, ny and nz")


def _in_plane(bits: np.ndarray, g: Geometry, start: np.ndarray, n: np.ndarray, how: str, rays: int) -> np.ndarray:
    """Distances in planes with normals n from points; MISS for a zero normal."""
    out = np.full(len(n), MISS)
    u = orthogonal(n)
    some = np.flatnonzero((u != 0).any(1))
    if not len(some):
        return out
    u, n, start = u[some], n[some], start[some]
    w = np.cross(n / np.sqrt((n * n).sum(1))[:, None], u)

    def ray(turn: list[float]) -> np.ndarray:
        c, s = np.array([math.cos(a) for a in turn]), np.array([math.sin(a) for a in turn])
        d = c[None, :, None] * u[:, None, :] + s[None, :, None] * w[:, None, :]
        return march(bits, g, np.repeat(start, len(turn), 0), d.reshape(-1, 3))[0].reshape(len(u), -1)

    if how == "two":
        turn = [math.pi * k / (rays - 1) for k in range(rays - 1)]
        out[some] = (ray(turn) + ray([a + math.pi for a in turn])).min(1)
        return out
    d = ray([2 * math.pi * k / (rays - 1) for k in range(rays)])
    if how == "one":
        out[some] = d.min(1)
    else:
        hit = d < MISS
        out[some] = np.where(hit, d, 0).sum(1) / np.maximum(hit.sum(1), 1)
    return out


def distance_map(voxels: DataFrame, g: Geometry, how: str = "one", plane: str = "axes", rays: int = 361, size: int = 40, sphere: np.ndarray | None = None, label: str = "label", mask: str | None = None) -> DataFrame:
    """(idx, distance) of foreground voxels in their plane: 'one' way, 'two' ways (least sum) or 'average'.

    plane: 'axes', 'sphere' (directions in ``sphere``) or 'normals' (columns nx, ny, nz). A zero normal gives MISS.
    """
    check_inputs(voxels, how, plane, sphere)
    bits = voxels.sparkSession.sparkContext.broadcast(packed(voxels, g, label))
    own = voxels.where((F.col(label) > 0) & (F.col(mask) > 0 if mask else F.lit(True)))
    own = own.select("idx", "x", "y", "z", *(["nx", "ny", "nz"] if plane == "normals" else []))
    some = max(1, RAYS_AT_ONCE // max(rays, len(sphere) if plane == "sphere" else 0))

    def run(batches):
        for t in batches:
            for a in range(0, len(t), some):
                part = t.iloc[a : a + some]
                at = part[["x", "y", "z"]].to_numpy(np.int64)
                start = np.array(g.origin) + at * np.array(g.voxel)
                if plane == "normals":
                    n = part[["nx", "ny", "nz"]].to_numpy(float)
                elif plane == "sphere":
                    hits = march(bits.value, g, np.repeat(start, len(sphere), 0), np.tile(sphere, (len(start), 1)))[1].reshape(len(start), -1, 3)
                    n = np.array([plane_by_hits(h[~np.isnan(h[:, 0])]) for h in hits])
                else:
                    n = planes_by_axes(bits.value, g, at, size)
                yield pd.DataFrame({"idx": part["idx"].to_numpy(), "distance": _in_plane(bits.value, g, start, n, how, rays)})

    return own.mapInPandas(run, "idx long, distance double")


def distance_field(voxels: DataFrame, distances: DataFrame) -> DataFrame:
    """(idx, distance) of every voxel: 0 where a map (idx, distance) has none."""
    return voxels.select("idx").join(distances, "idx", "left").fillna(0.0, ["distance"])


def ray_hits(points: DataFrame, voxels: DataFrame, g: Geometry, sphere: np.ndarray, label: str = "label") -> DataFrame:
    """(landmark_id, ray, x, y, z) where rays from points leave the foreground; (0, 0, 0) for a miss."""
    bits = voxels.sparkSession.sparkContext.broadcast(packed(voxels, g, label))
    some = max(1, RAYS_AT_ONCE // len(sphere))

    def run(batches):
        for t in batches:
            for a in range(0, len(t), some):
                part = t.iloc[a : a + some]
                start = np.repeat(part[["x", "y", "z"]].to_numpy(float), len(sphere), 0)
                at = np.nan_to_num(march(bits.value, g, start, np.tile(sphere, (len(part), 1)))[1])
                out = pd.DataFrame({"landmark_id": np.repeat(part["landmark_id"].to_numpy(), len(sphere)), "ray": np.tile(np.arange(len(sphere)), len(part))})
                yield out.assign(x=at[:, 0], y=at[:, 1], z=at[:, 2])

    return points.mapInPandas(run, "landmark_id long, ray int, x double, y double, z double")


def sphere_directions(n: int) -> np.ndarray:
    """n directions spread over the sphere (golden angle)."""
    k = np.arange(n) + 0.5
    z = 1 - 2 * k / n
    a = math.pi * (1 + 5**0.5) * k
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(a), r * np.sin(a), z], 1)

"""Index arithmetic, neighbourhoods and positions on a regular lattice, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbour offsets in the order in which ties between neighbours are resolved.
#: The first 6 are faces, the first 14 the simplicial neighbourhood, all 26 the full one.
OFFSETS = (
    (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1),
    (1, 1, 0), (-1, -1, 0), (0, 1, 1), (0, -1, -1), (1, 0, 1), (-1, 0, -1),
    (1, 1, 1), (-1, -1, -1),
    (1, -1, 0), (-1, 1, 0), (0, 1, -1), (0, -1, 1), (1, 0, -1), (-1, 0, 1),
    (1, 1, -1), (1, -1, 1), (-1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1),
)


def offsets(kind: str | int) -> list[tuple[int, int, int]]:
    """Offsets of the 6-, 14- (simplicial), 18- or 26-neighbourhood."""
    kind = int(kind)
    if kind == 18:
        return [o for o in OFFSETS if sum(map(abs, o)) <= 2]
    if kind not in (6, 14, 26):
        raise ValueError(f"no neighbourhood {kind}")
    return list(OFFSETS[:kind])


def forward(kind: str) -> list[tuple[int, int, int]]:
    """One offset of each opposite pair. 'corners26' has faces and corners only."""
    all26 = {"6": 1, "18": 2, "26": 3}
    if kind == "corners26":
        return [o for o in OFFSETS if sum(map(abs, o)) in (1, 3) and o[::-1] > (0, 0, 0)]
    return [o for o in OFFSETS if sum(map(abs, o)) <= all26[kind] and o[::-1] > (0, 0, 0)]


def linear_index(x: Column, y: Column, z: Column, nx: int, ny: int) -> Column:
    return (z.cast("long") * ny + y) * nx + x


def grid_position(idx: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    per = F.lit(nx * ny).cast("long")
    return (idx % nx).cast("int"), (F.floor(idx / nx) % ny).cast("int"), F.floor(idx / per).cast("int")


def in_grid(x: Column, y: Column, z: Column, dims: tuple[int, int, int]) -> Column:
    return x.between(0, dims[0] - 1) & y.between(0, dims[1] - 1) & z.between(0, dims[2] - 1)


def with_neighbors(voxels: DataFrame, shifts, *carry: str) -> DataFrame:
    """A row per voxel and shift: the carried columns, k (the shift's rank) and the neighbour's nx, ny, nz.

    Shifts are exploded from a literal, so the following equi-join on coordinates is the only shuffle.
    """
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for k, (a, b, c) in enumerate(shifts)])
    e = voxels.select("x", "y", "z", *carry, F.explode(table).alias("o"))
    return e.select(*carry, "o.k", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("z") + F.col("o.dz")).alias("nz"))


def neighbor_pairs(voxels: DataFrame, shifts, carry: tuple[str, ...], look: dict[str, str]) -> DataFrame:
    """Carried columns of a voxel beside the looked-up columns (new name -> column) of each neighbour that is in voxels."""
    other = voxels.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), *[F.col(c).alias(n) for n, c in look.items()])
    return with_neighbors(voxels, shifts, *carry).join(other, ["nx", "ny", "nz"])

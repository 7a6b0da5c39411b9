"""Sources and sinks: volume tables, dense grids, label fields, spreadsheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.lattice import grid_position


@dataclass(frozen=True)
class Geometry:
    """Dimensions, position of the first voxel's centre, voxel size."""

    dims: tuple[int, int, int]
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def size(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]

    def position(self, x="x", y="y", z="z"):
        """World coordinates of a voxel as columns px, py, pz."""
        return [(F.lit(o) + F.col(c) * F.lit(v)).alias("p" + n) for n, c, o, v in zip("xyz", (x, y, z), self.origin, self.voxel)]


def require(df: DataFrame, **kinds: str) -> DataFrame:
    """Raise unless df has these columns of these kinds ('integer', 'number' or a type's name)."""
    for c, kind in kinds.items():
        if c not in df.columns:
            raise ValueError(f"column {c} is missing; there are {df.columns}")
        t = df.schema[c].dataType
        ok = isinstance(t, T.IntegralType) if kind == "integer" else isinstance(t, T.NumericType) if kind == "number" else t.simpleString() == kind
        if not ok:
            raise ValueError(f"column {c} is {t.simpleString()}, not {kind}")
    return df


def load_directory(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """All files of a directory; volume_id is the file's name."""
    df = spark.read.format(file_format).load(path)
    return df.withColumn("volume_id", F.element_at(F.split("_metadata.file_path", "/"), -1))


def dense(cells: DataFrame, geometry: Geometry, **fill) -> DataFrame:
    """Every voxel of the grid: idx, x, y, z and the columns of cells (x, y, z, ...), filled where absent."""
    nx, ny, _ = geometry.dims
    x, y, z = grid_position(F.col("id"), nx, ny)
    grid = cells.sparkSession.range(geometry.size).select(F.col("id").alias("idx"), x.alias("x"), y.alias("y"), z.alias("z"))
    out = grid.join(cells, ["x", "y", "z"], "left")
    return out.select("idx", "x", "y", "z", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()])


def cast_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """Labels as int; raises on values outside 0..65535 when the rows are read."""
    bad = F.raise_error(F.concat(F.lit("label out of range: "), F.col(column).cast("string")))
    return df.withColumn(column, F.when(F.col(column).isNull() | F.col(column).between(0, 65535), F.col(column).cast("int")).otherwise(bad.cast("int")))


def write_label_fields(df: DataFrame, path: str, by: str = "persistence") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_spreadsheet(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or XML with one element per row."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.format("xml").option("rowTag", "row").save(path)


def write_selection(df: DataFrame, path: str) -> None:
    """An ordered selection (vertex_id, ord)."""
    df.select("vertex_id", "ord").write.mode("overwrite").parquet(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vertex_id long, ord long").parquet(path).orderBy("ord")


GEOMETRY = Geometry((24, 24, 24), (0.0, 0.0, 0.0), (1.0, 1.5, 2.0))
THRESHOLD = 100.0


def order_lattice(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """The lattice derived from lineitem: idx, x, y, z, v, label fields a and b, mask."""
    side = 24
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = lambda c: (F.col(c) % side).cast("int")
    cells = lines.groupBy(at("l_orderkey").alias("x"), at("l_partkey").alias("y"), at("l_suppkey").alias("z")).agg(F.sum("l_quantity").alias("v"))
    g = dense(cells, GEOMETRY, v=0.0)

    def blocks(n: int):
        b = lambda c: F.floor(F.col(c) / (side // n)).cast("int")
        return F.when(F.col("v") < threshold, 0).otherwise(1 + b("x") + n * b("y") + n * n * b("z")).cast("int")

    return g.withColumns({"a": blocks(4), "b": blocks(3), "mask": F.when((F.col("x") + F.col("y") + F.col("z")) % 7 == 0, 0).otherwise(1)})

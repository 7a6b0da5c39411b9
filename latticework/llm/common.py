"""Shared helpers of the corpus operators: staged tables, input checks, words of Arrow text.

Staged tables are Parquet folders under ``spark.checkpoint.dir``, which the
cluster shares between driver and executors. Reading one cuts the lineage, and
a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word in most contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, but only in one JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="latticework-"))
    return _own_dir[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*staged: DataFrame | None) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in staged:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """df, or a staged copy if its plan has an exchange: rows then come in the same order to a task that is tried again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stage(df, "stable") if "Exchange" in plan else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back to the system: Python workers stay for later tasks, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function of batches that releases memory when its task ends."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash; fails early if one is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*columns)


def ascii_lower(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of the filter in parted: 2 MB, in 512 rows.
FILTER_BITS = 1 << 24


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have (in any case), made from these."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def parted(rows: DataFrame, keys: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``by`` is surely not among keys (nor those with a null there), and rows where it may be.

    A bitmap of hashed keys, of fixed size, is broadcast, so the first rows need not move for a join.
    """
    bucket, bits, b, p = fresh(rows, "_bucket", "_bits", "_b", "_p")
    place = lambda: F.pmod(F.xxhash64(by), F.lit(FILTER_BITS))
    some = keys.select(F.bitmap_bucket_number(place()).alias(bucket), F.bitmap_bit_position(place()).alias("_bit"))
    some = some.groupBy(bucket).agg(F.bitmap_construct_agg("_bit").alias(bits))
    marked = rows.withColumns({b: F.bitmap_bucket_number(place()), p: F.bitmap_bit_position(place())})
    marked = marked.join(F.broadcast(some), F.col(b) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({p} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.col(by).isNotNull() & (byte.bitwiseAND(F.expr(f"shiftleft(1, cast({p} % 8 as int))")) != 0), F.lit(False))
    return marked.where(~hit).select(*rows.columns), marked.where(hit).select(*rows.columns)


def without_rows(docs: DataFrame, ids: DataFrame, by: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id (or column ``by``) is not among ids (no nulls), without moving the rows that
    surely stay. Rows with a null there stay."""
    ids = stage(ids.distinct(), "without-ids")
    stay, maybe = parted(docs, ids, by)
    return stay.union(maybe.join(ids, by, "left_anti").select(*docs.columns))


# ---------------------------------------------------------------- words, vectorised

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept once per process."""
    if len(_powers.get("p", ())) < n:
        for k, base in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(n, base, _U)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers["p"], _powers["q"]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (as int64, from 0) of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and text index of every word of every text."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SEP[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(buf)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word, which depends on its bytes only. What is held beside buf is bounded by blocks."""
    out = np.empty(len(starts), _U)
    p, q = _pow(_BLOCK + 1)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _BLOCK, side="right"))
        if j <= i:
            s, e = int(starts[i]), int(ends[i])
            value, shift, step = 0, 1, pow(_BASE, _BLOCK, 1 << 64)
            for a in range(s, e, _BLOCK):
                block = buf[a : min(e, a + _BLOCK)]
                block = _LOWER[block] if lower else block
                value += shift * int(((block.astype(_U) + _U(1)) * p[: len(block)]).sum())
                shift = shift * step % (1 << 64)
            h, size = np.array([value % (1 << 64)], _U), np.array([e - s], _U)
            out[i : i + 1] = mix64(h ^ (size * _U(0xD6E8FEB86659FD93)))
            i += 1
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        block = buf[lo:hi]
        if lower:
            block = _LOWER[block]
        h = np.zeros(hi - lo + 1, _U)
        np.cumsum((block.astype(_U) + _U(1)) * p[: hi - lo], out=h[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((h[e] - h[s]) * q[s] ^ ((e - s).astype(_U) * _U(0xD6E8FEB86659FD93)))
        i = j
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive values of h (across texts, too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    s = np.zeros(n, _U)
    for j in range(k):
        s += mix64(h[j : j + n] + _U((0xA0761D6478BD642F * (j + 1)) & (2**64 - 1)))
    return mix64(s)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int, most_rows: int):
    """Cut a batch so that each part has at most so many bytes of text (or one row) and rows."""
    n = batch.num_rows
    if not n:
        return
    _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most_bytes, side="right")) - 1
        j = min(n, i + most_rows, max(i + 1, j))
        yield batch.slice(i, j - i)
        i = j

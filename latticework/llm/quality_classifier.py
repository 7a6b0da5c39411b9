"""Quality classifier by co-training.

Two views see different things: one the text (hashed words and text statistics), one the
metadata (source, language, length). Texts are read once; their views are kept as sparse
features. Both views start from labelled documents. In every round each view scores every
unlabelled document, and what it is sure of becomes training data of the other view. These rows
are summed by class and bucket (a hash of the document's id), so that all of them count, while
the fitting set keeps a fixed size and no id weighs more than its bucket. At the end each view is
calibrated on labelled documents held out from training (Platt scaling), the calibrated views are
added as log odds, and every document is scored.

Only labelled documents are bounded: at most ``most_labelled``, chosen by a hash of their ids.
Features are half-precision numbers, whole multiples of 2^-24, and are summed as integers, so
that the sums don't depend on the order of rows or tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm.quality_rules import text_statistics

MOST_LABELLED = 4_000
WORD_DIMS, META_DIMS = 1_024, 128
STATISTICS = 9
TEXT_DIMS = WORD_DIMS + STATISTICS
BUCKETS = 64
_U = np.uint64
_ONE = 1 << 24
_FEATURES = "doc_id long, at binary, value binary, meta binary"
_SUMS = "view int, label int, bucket int, n long, sums binary"
_UPPER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[list(b"!?.,;:|")] = True


def _text_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word shares (square roots; WORD_DIMS columns) and statistics with a constant, in half precision."""
    n = len(texts)
    buf, off = C.text_buffer(texts)
    starts, ends, doc = C.words(buf, off)
    h = C.word_hashes(buf, starts, ends, lower=True)
    counts = np.bincount(doc * WORD_DIMS + (h % _U(WORD_DIMS)).astype(np.int64), minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    s = text_statistics(texts)
    words = np.maximum(s["n_words"], 1)
    size = np.maximum(off[1:] - off[:-1], 1)
    some = np.flatnonzero(off[1:] > off[:-1])

    def share(table):
        out = np.zeros(n)
        if len(some):
            out[some] = np.add.reduceat(table[buf], off[:-1][some], dtype=np.int64)
        return out / size

    more = [np.log1p(s["n_words"]) / 5, s["word_chars"] / words / 10, s["n_symbols"] / size * 10, s["n_dup_lines"] / words * 10, s["n_repeat_words"] / words, share(_UPPER) * 5, share(_DIGIT) * 5, share(_PUNCT) * 5, np.ones(n)]
    more = np.minimum(np.stack(more, 1), 1_000)
    return np.sqrt(counts / words[:, None]).astype("<f2"), more.astype("<f2")


def text_view(texts: pa.Array) -> np.ndarray:
    """Rows of TEXT_DIMS features."""
    return np.hstack(_text_parts(texts)).astype(np.float32)


def meta_slots(source: list, lang: list, n_chars: list) -> np.ndarray:
    """The columns of each row's source, language and length class, of META_DIMS; column 0 is the constant's."""
    known: dict[str, int] = {}
    out = np.empty((len(source), 3), np.uint8)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        for j, key in enumerate((f"source {s}", f"lang {g}", f"length {max(n or 1, 1).bit_length()}")):
            if key not in known:
                known[key] = 1 + zlib.crc32(key.encode()) % (META_DIMS - 1)
            out[i, j] = known[key]
    return out


def meta_view(slots: np.ndarray) -> np.ndarray:
    """Rows of META_DIMS features."""
    out = np.zeros((len(slots), META_DIMS), np.float32)
    out[:, 0] = 1
    for j in range(slots.shape[1]):
        out[np.arange(len(slots)), slots[:, j]] += 1
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Cuts an array in binary values that end at ``ends`` (in items)."""
    off = np.concatenate(([0], ends)).astype(np.int32) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The items of a binary column, and where each row's begin and end."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    items = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if len(column) else np.zeros(0, kind)
    return items, (off - off[0]) // np.dtype(kind).itemsize


def _extract(batches):
    for batch in batches:
        for part in C.slices(batch, "text", 2_000_000, 1_000):
            col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023,E731
            words, more = _text_parts(col("text"))
            row, at = np.nonzero(words)
            each = np.bincount(row, minlength=len(words)) + STATISTICS
            ends = np.cumsum(each)
            index, value = np.empty(ends[-1], "<u2"), np.empty(ends[-1], "<f2")
            last = (ends[:, None] - STATISTICS + np.arange(STATISTICS)).ravel()
            first = np.ones(ends[-1], bool)
            first[last] = False
            index[first], value[first] = at, words[row, at]
            index[last], value[last] = np.tile(np.arange(WORD_DIMS, TEXT_DIMS), len(words)), more.ravel()
            slots = meta_slots(col("source").to_pylist(), col("lang").to_pylist(), col("n_chars").to_pylist())
            yield pa.RecordBatch.from_arrays([col("doc_id"), _binary(index, ends), _binary(value, ends), _binary(slots.ravel(), np.arange(1, len(words) + 1) * 3)], ["doc_id", "at", "value", "meta"])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weighted logistic regression by Adam from zero (deterministic)."""
    x = np.ascontiguousarray(x, np.float32)  # products with doubles would copy it in every step
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ ((p - y) * weight).astype(np.float32) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_view(x: np.ndarray, y: np.ndarray, means: dict[int, np.ndarray], trust: float) -> np.ndarray:
    """A view's weights from labelled rows and, by class, the mean rows of its pseudo-labelled buckets.

    Both classes weigh the same; of a class that has buckets, these have the share ``trust``.
    """
    rows, truth, weight = [x], [y], [np.zeros(len(y))]
    for c in (0, 1):
        extra = means.get(c, np.zeros((0, x.shape[1])))
        own = trust if len(extra) else 0.0
        weight[0][y == c] = (1 - own) / 2 / max(1, (y == c).sum())
        rows.append(extra)
        truth.append(np.full(len(extra), c))
        weight.append(np.full(len(extra), own / 2 / max(1, len(extra))))
    return fit_logistic(np.concatenate(rows), np.concatenate(truth), np.concatenate(weight))


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset from a view's score to log odds, by Newton steps; the slope is never negative."""
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, x.T @ (p - target) + 1e-3 * np.array([a, 0]))
    return max(0.0, float(a)), float(b)


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrated(model, batch: pa.RecordBatch) -> tuple[list[np.ndarray], tuple, np.ndarray]:
    """Log odds by view, and the features they come from."""
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    (at, off), (value, _), slots = _flat(col("at"), "<u2"), _flat(col("value"), "<f2"), _flat(col("meta"), "u1")[0].reshape(-1, 3)
    (wt, a0, b0), (wm, a1, b1) = model
    text = np.add.reduceat(value.astype(np.float64) * wt[at], off[:-1]) if len(off) > 1 else np.zeros(0)
    return [a0 * text + b0, a1 * (wm[0] + wm[slots].sum(1)) + b1], (at, value, off), slots


def _sure_sums(model, sure: float):
    """What each view is sure of, as sums of the other view's features by class and bucket: a row per sum and task."""

    def run(batches):
        dims = (TEXT_DIMS, META_DIMS)
        sums = {(v, c): np.zeros(BUCKETS * dims[v], np.int64) for v in (0, 1) for c in (0, 1)}
        n = {k: np.zeros(BUCKETS, np.int64) for k in sums}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, (at, value, off), slots = _calibrated(model, batch)
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy().astype(np.int64)
            for view in (0, 1):
                p = _odds(z[1 - view])
                for c, rows in ((1, p >= sure), (0, p <= 1 - sure)):
                    if not rows.any():
                        continue
                    n[view, c] += np.bincount(bucket[rows], minlength=BUCKETS)
                    if view == 0:
                        mine = np.repeat(rows, np.diff(off))
                        key, weight = np.repeat(bucket, np.diff(off))[mine] * TEXT_DIMS + at[mine], value[mine].astype(np.float64) * _ONE
                        sums[view, c] += np.bincount(key, weight, BUCKETS * TEXT_DIMS).astype(np.int64)
                    else:
                        own = np.column_stack((np.zeros(rows.sum(), np.int64), slots[rows])) + bucket[rows, None] * META_DIMS
                        sums[view, c] += np.bincount(own.ravel(), minlength=BUCKETS * META_DIMS) * _ONE
        yield _sum_rows([(v, c, int(b), int(n[v, c][b]), sums[v, c].reshape(BUCKETS, -1)[b]) for v, c in sums for b in np.flatnonzero(n[v, c])])

    return run


def _sum_rows(rows) -> pa.RecordBatch:
    rows = [(*r[:4], r[4].astype("<i8").tobytes()) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["view", "label", "bucket", "n", "sums"])


def _add_sums(batches):
    """Rows with the same view, label and bucket to one; there are at most 4 * BUCKETS of these."""
    total: dict = {}
    for batch in batches:
        for v, c, b, n, x in zip(*(col.to_pylist() for col in batch.columns)):
            x = np.frombuffer(x, "<i8")
            before = total.get((v, c, b))
            total[v, c, b] = (n, x) if before is None else (before[0] + n, before[1] + x)
    yield _sum_rows([(*k, n, x) for k, (n, x) in total.items()])


def pseudo_means(pool: DataFrame, model, sure: float) -> list[dict[int, np.ndarray]]:
    """For each view the mean features of the buckets that the other view is sure of, by class."""
    sums = pool.mapInArrow(C.tidy(_sure_sums(model, sure)), _SUMS).repartition("view", "label", "bucket").mapInArrow(_add_sums, _SUMS)
    out: list[dict] = [{}, {}]
    for r in sorted(sums.collect(), key=lambda r: (r.view, r.label, r.bucket)):  # at most 4 * BUCKETS rows
        out[r.view].setdefault(r.label, []).append(np.frombuffer(r.sums, "<i8") / _ONE / r.n)
    return [{c: np.stack(m) for c, m in v.items()} for v in out]


def train(features: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = 3, sure: float = 0.95, trust: float = 0.5):
    """Models [(weights, slope, offset)] of the views and the log odds of the labels' prior; null where there are
    not both kinds of labels, for fitting and for calibration."""
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = C.stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled), "quality-labelled")
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("at", "value", "meta")).alias("x")).select("doc_id", "label", "x.*")
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)  # at most most_labelled
    if not rows:
        return None
    text, slots = np.zeros((len(rows), TEXT_DIMS), np.float32), np.array([list(r.meta) for r in rows])
    for x, r in zip(text, rows):
        x[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.value, "<f2")
    y, views = np.array([r.label for r in rows]), [text, meta_view(slots)]
    held = C.mix64(np.array([r.doc_id for r in rows], np.int64).astype(_U)) % _U(4) == 0
    if min((y[held] == 1).sum(), (y[held] == 0).sum(), (y[~held] == 1).sum(), (y[~held] == 0).sum()) == 0:
        return None
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    pool = C.stage(features.join(known.select("doc_id"), "doc_id", "left_anti").select(bucket, "at", "value", "meta"), "quality-pool") if rounds else None
    means: list[dict] = [{}, {}]
    for turn in range(rounds + 1):
        weights = [fit_view(x[~held], y[~held], m, trust) for x, m in zip(views, means)]
        model = [(w, *fit_platt(x[held] @ w, y[held])) for x, w in zip(views, weights)]
        if turn < rounds:
            means = pseudo_means(pool, model, sure)
    prior = (y[held].sum() + 1) / (held.sum() + 2)
    return model, float(np.log(prior / (1 - prior)))


def _score(model, least: float):
    def run(batches):
        for batch in batches:
            if model is None:
                z = [np.zeros(batch.num_rows)] * 2
                total = z[0]
            else:
                z = _calibrated(model[0], batch)[0]
                total = z[0] + z[1] - model[1]
            p = _odds(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_odds(z[0])), pa.array(_odds(z[1])), pa.array(p), pa.array(p >= least)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, least: float = 0.2, **training) -> DataFrame:
    """One row per document: doc_id, p_text, p_meta, score (probability of good quality), kept.

    ``labels``: (doc_id, label 0/1); the lower of several counts. Without labels of both kinds
    every score is 0.5. Null and empty texts, sources, languages and lengths are features like
    any other. A null doc_id has no label, but is learnt from and scored. Repeated rows give
    repeated rows; of labelled rows of one doc_id that differ, the one with the smallest features
    is learnt from. Missing columns count as null, others are ignored. No documents: no rows.
    """
    for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long")):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast(kind))
    docs = C.need(docs, "doc_id", "text", "source", "lang", "n_chars")
    features = C.stage(docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long")).mapInArrow(C.tidy(_extract), _FEATURES), "quality-features")
    model = train(features, C.need(labels, "doc_id", "label"), **training)
    return features.mapInArrow(_score(model, least), "doc_id long, p_text double, p_meta double, score double, kept boolean")

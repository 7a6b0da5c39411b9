"""Quality rules with host-level verdicts.

Each document is held against plain rules. Failures are then counted by host, and a host's rate
is shrunk with a beta prior whose mean and strength come from all hosts (method of moments). A
host is rejected if the lower bound of its posterior rate is over the threshold; its verdict is
joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_U = np.uint64
LONG_BYTES = 4_000_000


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text: words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    n = len(texts)
    buf, off = C.text_buffer(texts)
    starts, ends, doc = C.words(buf, off)

    def per_text(mask: np.ndarray) -> np.ndarray:
        if len(mask) > LONG_BYTES:  # positions would take eight times the text
            out, some = np.zeros(n, np.int64), np.flatnonzero(off[1:] > off[:-1])
            out[some] = np.add.reduceat(mask, off[:-1][some], dtype=np.int64)
            return out
        at = np.flatnonzero(mask)
        return np.searchsorted(at, off[1:]) - np.searchsorted(at, off[:-1])

    h = C.word_hashes(buf, starts, ends, lower=False)
    w = C.window_hashes(h, 3)
    ok = doc[: len(w)] == doc[2:] if len(w) else np.zeros(0, bool)
    covered = np.zeros(len(h), bool)
    at = np.flatnonzero(ok)
    if len(at):
        key = C.mix64(w[at] + doc[at].astype(_U) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            covered[at[twice] + j] = True
    is_break = buf == 10
    breaks = np.flatnonzero(is_break)
    line_starts = np.union1d(off[:-1][off[:-1] < len(buf)], breaks[breaks + 1 < len(buf)] + 1).astype(np.int64)
    line_ends = np.minimum(np.append(line_starts[1:], len(buf)), len(buf))
    line_ends = line_ends - ((line_ends > line_starts) & is_break[np.maximum(line_ends - 1, 0)]) if len(buf) else line_ends
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_doc = np.searchsorted(off, line_starts, side="right") - 1
    key = C.mix64(C.word_hashes(buf, line_starts, line_ends, lower=False) + line_doc.astype(_U) * _U(0x9E3779B97F4A7C15))
    _, one = np.unique(key, return_index=True)
    count = lambda d: np.bincount(d, minlength=n).astype(np.int64)
    return {
        "n_words": count(doc),
        "word_chars": per_text(~C._SEP[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_text(_IS_SYMBOL[buf]),
        "n_dup_lines": count(line_doc) - count(line_doc[one]),
        "n_repeat_words": count(doc[covered]),
    }


def _measure(batches):
    for batch in batches:
        for part in C.slices(batch, "text", 1_000_000, 20_000):
            stats = text_statistics(part.column(part.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(stats[c]) for c in _STATS]], ["doc_id", "host", *_STATS])


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    d = C.need(docs, *dict.fromkeys(["doc_id", host, "text"]))
    d = d.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), "text")
    return d.mapInArrow(C.tidy(_measure), "doc_id long, host string, " + ", ".join(f"{c} long" for c in _STATS))


def host_rates(stats: DataFrame, threshold: float, z: float) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_low, host_kept) by an empirical beta prior."""
    hosts = C.stage(stats.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")), "quality-hosts")
    r = hosts.agg(F.count("*").alias("k"), F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(F.col("host_docs") * F.col("host_docs")).alias("nn"), F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")).alias("ff")).first()
    p, strength = (r.f + 1) / (r.n + 2) if r.n else 0.5, 10.0
    if r.n and r.k > 1 and 0 < r.f < r.n:
        q = r.f / r.n
        between = (r.ff - r.n * q * q - (r.k - 1) * q * (1 - q)) / (r.n - r.nn / r.n)
        strength = 1 / min(0.5, max(0.001, between / (q * (1 - q)))) - 1
    rate = (F.col("host_failed") + strength * p) / (F.col("host_docs") + strength)
    low = F.greatest(F.lit(0.0), F.col("host_rate") - z * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("host_docs") + strength + 1)))
    return hosts.withColumn("host_rate", rate).withColumn("host_low", low).withColumn("host_kept", F.col("host_low") <= threshold)


def judge_documents(docs: DataFrame, host: str = "source", threshold: float = 0.6, z: float = 1.64) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, then host, host_rate, host_low.

    A document fails with under 50 words or with over half of them in repeated windows. It is kept
    if it doesn't fail and its host isn't rejected. Null and empty texts have no words and fail.
    Documents without a host are a host of their own. Repeated rows count as often as they occur.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = C.stage(statistics(docs, host).withColumn("failed", failed), "quality-stats")
    hosts = host_rates(stats, threshold, z).withColumnRenamed("host", "_h")
    out = stats.join(hosts, F.col("host").eqNullSafe(F.col("_h")), "left")
    return out.select("doc_id", *_STATS, F.col("failed").alias("base_failed"), (~F.col("failed") & F.col("host_kept")).alias("kept"), "host", "host_rate", "host_low")

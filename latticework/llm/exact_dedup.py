"""Exact dedup: tree-merge of sorted digest runs, with DataFrame operations only.

Each task that reads documents leaves a *run*: the digests of its texts, sorted. In every
round the runs of ``fan_in`` neighbouring groups merge (multiway) into one, split by digest
over the cluster; a digest keeps the surviving row and the count. After about
``log(runs) / log(fan_in)`` rounds one run is left. The verdicts go down the same tree, so
that a digest which a third of all rows share meets at most ``fan_in`` rows of its own in any
round, and in the last one the rows of a single run.

With DataFrame operations alone, the merge of a round is an exchange by (group, digest), a sort of
the sorted pieces that arrive, and an aggregate over equal neighbours; that runs are written in
order serves their size and the reads of single digests, not the next round's sort.

A digest is verified in every round by what is carried beside it: SHA-256, byte length and
an independent 64-bit hash must all agree, else the texts count as different.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C

KEY = ["text_sha256", "bytes", "check"]


def exact_duplicates(docs: DataFrame, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared unchanged; null counts as empty. ``keep`` is 'largest' or 'smallest'
    doc_id; a null doc_id stays only if its group has no other. Of repeated rows with one
    doc_id, one is kept. Empty table: no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    d = C.need(docs, "doc_id", "text").select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("check"))
    d = d.withColumn("row", F.monotonically_increasing_id()).withColumn("run", F.shiftright("row", 33))
    d = C.stage(d.sortWithinPartitions(*KEY), "dedup-digests")
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    order = F.col("doc_id") if keep == "largest" else -F.col("doc_id")
    level = d.groupBy("run", *KEY).agg(F.max(F.struct(order.alias("o"), "doc_id", "row")).alias("best"), F.count("*").alias("size"))
    levels = [C.stage(level.sortWithinPartitions(*KEY), "dedup-run")]
    runs = (levels[0].agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        up = levels[-1].withColumn("run", F.expr(f"run div {fan_in}")).groupBy("run", *KEY).agg(F.max("best").alias("best"), F.sum("size").alias("size"))
        levels.append(C.stage(up.sortWithinPartitions(*KEY), "dedup-run"))
        runs = -(-runs // fan_in)
    down = levels.pop().where("size > 1").select("run", *KEY, "best", "size")
    for below in reversed(levels):
        mine = below.select(F.col("run").alias("leaf"), F.expr(f"run div {fan_in}").alias("run"), *KEY)
        down = mine.join(down, ["run", *KEY]).select(F.col("leaf").alias("run"), *KEY, "best", "size")
    out = d.join(down, ["run", *KEY], "left")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

"""The corpus pipeline: rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents. Rows
are judged one by one, with or without an id; an empty table gives an empty table in every stage;
columns beside those of documents are carried along by the filters, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm.exact_dedup import exact_duplicates
from latticework.llm.ngram_join import ngram_jaccard_components
from latticework.llm.packing import pack_documents
from latticework.llm.quality_rules import judge_documents
from latticework.llm.registry import tokenizer_path
from latticework.llm.source_mixing import mix_sources


def _key(*columns):
    """A hash of columns by which rows are told apart; nulls count as values, by place."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def _kept(docs, changed, key):
    """The rows of docs less those that go: changed (key, k) names the keys not all of whose rows stay. Of such a
    key no row stays (k = 0) or one (k = 1), the smallest by its columns."""
    (own,) = C.fresh(docs, "_key")
    keyed = docs.withColumn(own, key)
    changed = C.stage(changed.select(F.col("key").alias(own), "k"), "pipeline-changed")
    stay = C.without_rows(keyed, changed.select(own), own).select(*docs.columns)
    once = keyed.join(changed.where("k = 1").select(own), own, "left_semi")
    once = once.groupBy(own).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return stay.union(once)


def quality_rules(spark, docs, sf_dir):
    """Rows that the rules reject go, with or without an id."""
    key = _key(F.col("doc_id"), F.col("source"), F.col("text"))
    verdicts = judge_documents(docs.withColumn("doc_id", key))  # equal rows have equal verdicts
    return _kept(docs, verdicts.where("not kept").select(F.col("doc_id").alias("key"), F.lit(0).alias("k")).distinct(), key)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts one row stays, of the largest doc_id; one without an id only if no other has one."""
    verdicts = exact_duplicates(docs).where("group_size > 1").withColumn("key", _key(F.col("doc_id"), F.col("text_sha256")))
    changed = verdicts.groupBy("key").agg(F.max(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n")).where("k < n").select("key", "k")
    return _kept(docs, changed, _key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def ngram_join(spark, docs, sf_dir):
    """Of each group of near duplicates one row stays, of the smallest doc_id; one without an id only if no other
    has one. Rows without words stay."""
    key = _key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(key.alias("doc_id"), "text")
    rows = C.stage(ngram_jaccard_components(keyed).where("n_shingles > 0").groupBy("component_id", "doc_id").agg(F.count("*").alias("n")), "pipeline-components")
    several = C.stage(rows.groupBy("component_id").agg(F.sum("n").alias("all")).where("all > 1").select("component_id"), "pipeline-groups")
    rows = rows.join(several, "component_id", "left_semi").select("component_id", F.col("doc_id").alias("key"), "n")
    ids = docs.select(key.alias("key"), "doc_id").distinct()
    best = rows.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    changed = rows.join(best, "component_id").select("key", (F.col("key") == F.col("best.key")).cast("int").alias("k"), "n").where("k < n")
    return _kept(docs, changed.select("key", "k"), key)


def mix(spark, docs, sf_dir):
    """Documents are repeated as often as the mix takes them, or left out. A null source is a source of its own; rows
    without words (null, empty) are never taken."""
    mixed = mix_sources(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))).where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def packing(spark, docs, sf_dir):
    """The pieces of all documents with their places in sequences. A null or empty text is its end id only; repeated
    rows are packed as often as they occur, with or without an id."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("mixing sources", mix),
    ("packing", packing),
]

#: Tokenization and bin packing are beyond SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stage(stage(spark, docs, sf_dir), "pipeline-docs")
    return STAGES[-1][1](spark, docs, sf_dir)

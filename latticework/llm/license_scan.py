"""License scan by diagonal voting, with DataFrame operations only.

Every text is split into words once. Every rolling k-gram of words of every text is hashed and
joined to the positions it has in license templates; the words of a hit are then compared one by
one, so that hashes only find candidates. A hit votes for the diagonal (place in the text minus
place in the template); votes add up by diagonal, diagonals a few words apart merge (insertions
and deletions), and a merged span is verified by the words it really shares: they must cover
enough of the template, and enough of the span in the text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm.license_texts import TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, of lower-cased texts.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrase and label
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: The table of template k-grams is broadcast; a larger one is an error, never cut.
MOST_TEMPLATE_GRAMS = 200_000


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(C.ASCII_UPPER, C.ASCII_LOWER)))


def _template_grams(spark: SparkSession, templates, k: int) -> DataFrame:
    """A row per different k-gram of the templates: h, own (its words), places (template, label, at, size)."""
    places: dict[tuple, list] = {}
    for t, (label, text) in enumerate(templates):
        w = template_words(text)
        for i in range(len(w) - k + 1):
            places.setdefault(tuple(w[i : i + k]), []).append((t, label, i, len(w)))
    if sum(map(len, places.values())) > MOST_TEMPLATE_GRAMS:
        raise ValueError(f"{sum(map(len, places.values()))} template k-grams; at most {MOST_TEMPLATE_GRAMS} are broadcast")
    rows = [(list(g), p) for g, p in places.items()]
    grams = spark.createDataFrame(rows, "own array<string>, places array<struct<template:int,label:string,at:int,size:int>>")
    return grams.select(F.xxhash64(*[F.get("own", F.lit(i)) for i in range(k)]).alias("h"), "own", "places")


def _lowered(text):
    """Unicode lower case is the fastest; it makes an ASCII letter of one other character only, the Kelvin sign."""
    return F.when(F.contains(text, F.lit("\u212a")), C.ascii_lower(text)).otherwise(F.lower(text))


def _hits(docs: DataFrame, phrases, templates, k: int) -> DataFrame:
    """(row, doc_id, n_words, pos, mask, places): a row for the first word (or none) of every text, and one for every
    word where a phrase stands (a bit each) or a k-gram of a template. One pass over the texts."""
    words = F.array_remove(F.split(_lowered(F.coalesce("text", F.lit(""))), GAP), "")
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("w"))
    d = d.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w", F.posexplode_outer("w").alias("pos", "word"))
    at = lambda i: F.col("word") if not i else F.get("w", F.col("pos") + i)
    bits = [F.when(reduce(lambda a, b: a & b, [at(i) == x for i, x in enumerate(p.split())]), 1 << n).otherwise(0) for n, (p, _) in enumerate(phrases)]
    d = d.withColumns({"mask": reduce(lambda a, b: a + b, bits, F.lit(0)), "hash": F.xxhash64(*[at(i) for i in range(k)])})
    found = d.join(F.broadcast(_template_grams(docs.sparkSession, templates, k)), F.col("hash") == F.col("h"), "left")
    same = reduce(lambda a, b: a & b, [at(i).eqNullSafe(F.get("own", F.lit(i))) for i in range(k)])
    found = found.withColumn("places", F.when(F.col("own").isNotNull() & same, F.col("places")))
    return found.where((F.coalesce("pos", F.lit(0)) == 0) | (F.col("mask") > 0) | F.col("places").isNotNull()).select("row", "doc_id", "n_words", "pos", "mask", "places")


def _spans(hits: DataFrame, k: int, drift: int, least: float) -> DataFrame:
    """A row to its verified labels and the best coverage."""
    votes = hits.where("places is not null").select("row", "pos", F.explode("places").alias("p")).select("row", "pos", "p.*")
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    votes = votes.groupBy("row", "template", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"), F.collect_set("pos").alias("pos"))
    new = (F.col("diagonal") - F.lag("diagonal").over(by) > drift).cast("int")
    merged = votes.withColumn("group", F.sum(F.coalesce(new, F.lit(1))).over(by))
    merged = merged.groupBy("row", "template", "label", "size", "group").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("pos")).alias("pos"), (F.max("diagonal") - F.min("diagonal")).alias("bend"))
    covered = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda x: F.sequence(x, x + (k - 1))))))
    span = F.array_max("pos") - F.array_min("pos") + k
    merged = merged.withColumns({"cover": covered("at") / F.col("size"), "dense": covered("pos") / span})
    good = merged.where((F.col("cover") >= least) & (F.col("dense") >= least) & (F.col("bend") <= F.greatest(F.lit(drift), F.col("size"))))
    return good.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, k: int = 3, drift: int = 3, least: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels are those of phrases whose words stand in a row; the method adds labels of
    templates it finds. Score: the best coverage of a template, 1 with a base label, else 0. Null
    and empty texts have no words and no labels. Rows are judged one by one, with or without a
    doc_id; repeated rows give repeated rows; other columns are ignored; an empty table gives none.
    """
    hits = C.stage(_hits(C.need(docs, "doc_id", "text"), phrases, templates, k), "license-hits")
    place = F.when(F.col("mask") > 0, F.col("pos").cast("long"))
    base = hits.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("long").alias("n_base"),
        F.min(place).alias("first_word"), F.max(place).alias("last_word"), F.bit_or("mask").alias("mask"),
    )
    base = base.withColumn("bl", F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(1 << n) > 0, F.lit(label)) for n, (_, label) in enumerate(phrases)])))
    out = base.join(_spans(hits, k, drift, least), "row", "left")
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    labels = F.concat("bl", F.coalesce("found", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", join("bl").alias("base_labels"), join(labels).alias("labels"), score.alias("score"))

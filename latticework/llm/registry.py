"""The queries of the corpus operators: name -> callable(spark, sf_dir), and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm import exact_dedup, sql
from latticework.llm.license_scan import scan_licenses
from latticework.llm.ngram_join import ngram_jaccard_components
from latticework.llm.packing import pack_documents
from latticework.llm.quality_classifier import score_documents
from latticework.llm.quality_rules import judge_documents
from latticework.llm.secrets import scan_secrets
from latticework.llm.source_mixing import mix_sources
from latticework.llm.url_reputation import filter_urls, page_outcomes
from latticework.llm.warc import archive_pages


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_join(spark, sf_dir):
    return ngram_jaccard_components(C.read(spark, sf_dir, "documents"), k=5, percent=80)


def op1_ngram_links(spark, sf_dir):
    return ngram_jaccard_components(C.read(spark, sf_dir, "documents"), k=5, percent=80, links=True)


def op2_url_reputation(spark, sf_dir):
    out = filter_urls(C.read(spark, sf_dir, "pages"), page_outcomes(C.read(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_source_mixing(spark, sf_dir):
    out = mix_sources(C.read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark, sf_dir):
    return pack_documents(C.read(spark, sf_dir, "documents"), tokenizer_path())


def op5_secret_scan(spark, sf_dir):
    return scan_secrets(C.read(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return judge_documents(C.read(spark, sf_dir, "documents")).drop("host", "host_rate", "host_low")


def op7_quality_classifier(spark, sf_dir):
    labels = C.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return score_documents(C.read(spark, sf_dir, "documents"), labels)


def op8_license_scan(spark, sf_dir):
    return scan_licenses(C.read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(C.read(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return archive_pages(C.read(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_join, op1_ngram_links, op2_url_reputation, op3_source_mixing, op4_packing, op5_secret_scan, op6_quality_rules, op7_quality_classifier, op8_license_scan, op9_exact_dedup, op10_warc)
}
ORACLES = {
    "op1_ngram_join": sql.NGRAM_JOIN,
    "op1_ngram_links": sql.NGRAM_LINKS,
    "op2_url_reputation": sql.URL_REPUTATION,
    "op3_source_mixing": sql.SOURCE_MIXING,
    "op6_quality_rules": sql.QUALITY_RULES,
    "op8_license_scan": sql.LICENSE_SCAN,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_warc": sql.WARC,
}

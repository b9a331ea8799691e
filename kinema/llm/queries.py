"""The training-data queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, licences, lines, oracle, packing, quality, resample, search, secrets, simhash, suffix, urls, warc
from .common import scratch_path, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("spans")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_warc(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("url")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.expr(oracle.queries_path("div", "string")))
    return licences.scan_licences(docs, keep=("doc_id",))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("found")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("accesses")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_urls": op2_urls,
    "op3_html": op3_html,
    "op4_decontaminate": op4_decontaminate,
    "op5_licences": op5_licences,
    "op6_suffix": op6_suffix,
    "op7_quality": op7_quality,
    "op8_pack": op8_pack,
    "op9_warc": op9_warc,
    "op10_lines": op10_lines,
    "op11_secrets": op11_secrets,
    "op12_search": op12_search,
    "op13_resample": op13_resample,
}
ORACLE_SQL = oracle.ORACLE_SQL

"""The queries opN_<name> and the pipeline, with SQL where SQL can state their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from newstide.llm import (
    byte_bpe,
    filter_audit,
    html_extract,
    license_scan,
    line_dedup,
    near_dups,
    neighbours,
    oracles,
    packing,
    periodic_runs,
    quality,
    sharding,
    toxicity,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf, "documents").select("doc_id", "text"))
    places = F.col("base.k")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.assess(docs, _table(spark, sf, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "expected", F.size("spans").alias("n_spans"), "spans")


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.assess(_table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"), "kept")


def op8_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf, "documents"))


def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN, back="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rest = line_dedup.drop_shared_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return rest.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    found = periodic_runs.with_runs(docs.select("doc_id", periodic_runs.repeated_tail(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.col("best")
    return found.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    entries = filter_audit.entries(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return filter_audit.audit(entries, "ABCDE", ["good", "toxic"])


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_license_scan": op2_license_scan,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_html_extraction": op5_html_extraction,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_dups": op8_near_dups,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_nearest": op10_nearest,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op7_quality_rules": oracles.quality_rules(),
    "op8_near_dups": oracles.near_dups(),
    "op11_line_dedup": oracles.line_dedup(),
    "op12_periodic_runs": oracles.periodic_runs(),
    "op13_filter_audit": oracles.filter_audit(),
}

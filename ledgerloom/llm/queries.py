"""The registered queries: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, linededup, mixing, neardup, oracles, pii, secrets, urls, warc
from .common import table


def _equals(value: str):
    return lambda x: x == value


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_kind(F.col("base"), k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.col("base.kind"), _equals(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op9: its base kinds."""
    return op9_secrets(spark, sf_dir).drop("spans")


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op10: its base kinds."""
    return op10_pii(spark, sf_dir).drop("spans")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op5: hosts, paths, rules and the verdicts of rules."""
    return op5_url_filter(spark, sf_dir).withColumn("verdict", F.when(F.col("rule").isNotNull(), F.col("verdict")))


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2: sizes and targets, to three decimals."""
    return op2_mix_sources(spark, sf_dir).select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    parts = {"base_secrets": base_secrets, "base_pii": base_pii, "url_rules": url_rules, "source_targets": source_targets}
    return parts | {"op1_decontaminate": op1_decontaminate, "op2_mix_sources": op2_mix_sources, "op3_language_id": op3_language_id, "op4_nearest": op4_nearest, "op5_url_filter": op5_url_filter, "op6_warc": op6_warc, "op7_near_dedup": op7_near_dedup, "op8_line_dedup": op8_line_dedup, "op9_secrets": op9_secrets, "op10_pii": op10_pii}


def oracle_sql() -> dict[str, str]:
    parts = {"base_secrets": oracles.SECRETS_BASE, "base_pii": oracles.PII_BASE, "url_rules": oracles.URL_RULES, "source_targets": oracles.SOURCE_TARGETS}
    return parts | {"op6_warc": warc.ORACLE, "op7_near_dedup": neardup.ORACLE, "op8_line_dedup": linededup.ORACLE}

"""Queries over the driver's tables, one for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import importance_resampling, language_id, licence_scan, line_dedup, ngram_join, png_media, quality_rules, sentencepiece_bpe, source_mix, spelling_groups, suffix_dedup, toxicity, warc_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """Serialized tokenizer model of the public files; the driver reads it and broadcasts it."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(docs, piece_model()))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan_licences(table(spark, sf_dir, "documents")).drop("spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc_archive.write_archives(pages)
    return warc_archive.digests(warc_archive.read_records(index, payloads=False), pages.schema["page_id"].dataType.simpleString())


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return png_media.digests(png_media.read_media(png_media.store_media(docs)))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), n=4, percent=85, block_rows=1024, count_links=True)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_runs(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mix.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.grouped(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identified(docs, language_id.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_licence_scan": op2_licence_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_media_columns": op5_media_columns,
    "op6_ngram_join": op6_ngram_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.SQL,
    "op4_warc": warc_archive.SQL,
    "op6_ngram_join": ngram_join.LINKS_SQL,
    "op7_line_dedup": line_dedup.RUNS_SQL,
    "op9_source_mix": source_mix.SQL,
    "op11_spelling_variants": spelling_groups.SQL,
    "op12_importance_resampling": importance_resampling.SQL,
}

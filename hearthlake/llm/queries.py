"""The queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, exact_dedup, langid, licenses, line_quality, media, mixing, secrets, sentencepieces, simhash, spellings, token_files, url_filter


def tokenizer_file(name: str) -> str:
    """Public vocabulary files; their place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op1(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op2(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op3(documents(spark, sf_dir))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op5(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6(documents(spark, sf_dir))


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op7(documents(spark, sf_dir))


def op8_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.op8(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op10(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.op11(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.op12(documents(spark, sf_dir))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op13(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_url_templates, op2_cuckoo_dedup, op3_secret_scan, op4_simhash_bktree, op5_license_scan,
        op6_language_id, op7_iso_media, op8_sentencepiece_lattice, op9_cube_mixing, op10_token_files,
        op11_line_quality, op12_spelling_variants, op13_phrase_collocations,
    ]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """Where DuckDB can express the whole result; the others are tested against brute force."""
    return {"op2_cuckoo_dedup": exact_dedup.ORACLE, "op11_line_quality": line_quality.ORACLE, "op13_phrase_collocations": collocations.ORACLE}

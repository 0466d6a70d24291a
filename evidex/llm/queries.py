"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidex.llm import exact_dedup, html_extract, licenses, merkle, mixing, packing, pii, prefix_trie, quality_model, quality_rules, simhash, sketch, token_files


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": lambda spark, sf: simhash.near_duplicates(_documents(spark, sf)),
        "op2_quality_rules": lambda spark, sf: quality_rules.judged(_documents(spark, sf)),
        "op3_token_files": lambda spark, sf: token_files.token_files(_documents(spark, sf), _tokenizer("byte_bpe_50k.json"), end_id=0),
        "op4_personal_data": lambda spark, sf: pii.find_personal_data(_documents(spark, sf)),
        "op5_exact_dedup": lambda spark, sf: exact_dedup.exact_duplicates(_documents(spark, sf)),
        "op6_license_scan": lambda spark, sf: licenses.scan(_documents(spark, sf)),
        "op7_html_text": lambda spark, sf: html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")),
        "op8_source_mix": lambda spark, sf: mixing.mix(_documents(spark, sf)),
        "op9_packing": lambda spark, sf: packing.pack_documents(_documents(spark, sf), _tokenizer("word_bpe_49k.json"), end_id=1),
        "op10_quality_classifier": lambda spark, sf: quality_model.quality_scores(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")),
        "op11_document_fingerprints": lambda spark, sf: sketch.edited_likeness(_documents(spark, sf)),
        "op12_prefix_trie": lambda spark, sf: prefix_trie.prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet")),
        "op13_merkle_manifest": lambda spark, sf: merkle.manifest_rows(_documents(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.ORACLE, "op6_license_scan": licenses.oracle_sql(), "op8_source_mix": mixing.oracle_sql(), "op12_prefix_trie": prefix_trie.ORACLE, "op13_merkle_manifest": merkle.ORACLE}

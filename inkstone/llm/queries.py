"""Queries over whole tables, one for each operator of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.neardup_vectors import vector_components

    return vector_components(_table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.urlfilter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkstone.llm.piece_bpe import piece_digests

    return piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.linededup import drop_boilerplate

    return drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkstone.llm.tokenfile import read_checksums, write_tokens

    return read_checksums(write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.htmltext import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.maxent import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.ranked import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {"op1_embedding_dedup": op1_embedding_dedup, "op2_url_filter": op2_url_filter, "op3_toxicity": op3_toxicity, "op4_sentencepiece": op4_sentencepiece, "op5_simhash": op5_simhash, "op6_line_dedup": op6_line_dedup, "op7_token_file": op7_token_file, "op8_decontamination": op8_decontamination, "op9_language_id": op9_language_id, "op10_html_text": op10_html_text, "op11_lm_scores": op11_lm_scores, "op12_source_divergence": op12_source_divergence, "op13_ranked_search": op13_ranked_search}


def oracle_sql() -> dict[str, str]:
    from inkstone.llm.decontaminate import contaminated_sql
    from inkstone.llm.divergence import divergence_sql
    from inkstone.llm.linededup import dropped_lines_sql
    from inkstone.llm.ranked import search_sql
    from inkstone.llm.urlfilter import filter_sql

    return {"op2_url_filter": filter_sql("pages"), "op6_line_dedup": dropped_lines_sql("documents", "source"), "op8_decontamination": contaminated_sql("documents", "benchmark"), "op12_source_divergence": divergence_sql("documents"), "op13_ranked_search": search_sql("documents", "benchmark")}

"""Queries over the whole tables for each operator of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parley.llm import exact_dedup, html_text, pii, quality, simhash, tree_bpe, url_rules
from parley.llm.common import materialise, shared_folder, table
from parley.llm.packing import pack
from parley.llm.token_counts import Ledger, count_tokens, deletes, inserts, revisions
from parley.llm.token_files import read_token_files, write_token_files

WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_multi_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents, each sent twice: loaded with their words as a first estimate, revised to their
    tokens, and taken down where they are labelled toxic."""
    counts = materialise(count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), "word_bpe_49k"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    ledger = Ledger(spark, shared_folder(spark))
    for _ in range(2):
        ledger.commit("load", inserts(counts, "n_words"))
        ledger.commit("recount", revisions(counts, "n_words", "n_tokens"))
        ledger.commit("takedown", deletes(counts.join(toxic, "doc_id", "left_semi")))
    return ledger.totals()


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), end_id=1)
    return read_token_files(files)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.PATTERN)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), end_id=0, size=2048)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_all(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_token_files, op3_html_text, op4_exact_dedup, op5_tree_bpe,
        op6_simhash_near_dedup, op7_url_rules, op8_best_fit_packing, op9_pii, op10_quality_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.oracle(),
    "op7_url_rules": url_rules.oracle(),
}

"""Registered queries of the training-data operators."""

from __future__ import annotations

from .ann import neighbours_of_embeddings
from .common import read_table
from .decontaminate import contamination_report
from .fim import transformed_documents
from .htmltext import page_texts
from .langid import language_of_documents
from .license import licences_of_documents
from .mixing import mixture_of_documents
from .pack import packed_documents
from .quality import grade_documents
from .secrets import secrets_of_documents
from .simhash import simhash_groups
from .sql import SQL  # noqa: F401  (exported with the queries)
from .tokencount import maintained_counts
from .trie import trie_of_conversations


def op1_language_id(spark, sf_dir):
    return language_of_documents(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secrets_of_documents(read_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    return grade_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark, sf_dir):
    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_simhash_neardup(spark, sf_dir):
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark, sf_dir):
    return mixture_of_documents(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return maintained_counts(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return licences_of_documents(read_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark, sf_dir):
    return page_texts(read_table(spark, sf_dir, "pages"))


def op10_ann(spark, sf_dir):
    return neighbours_of_embeddings(read_table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark, sf_dir):
    return trie_of_conversations(read_table(spark, sf_dir, "conversations"))


def op12_packing(spark, sf_dir):
    return packed_documents(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    return transformed_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_source_mixing": op5_source_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_html_extraction": op8_html_extraction,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_ann": op10_ann,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}

"""Stages of the corpus pipeline: each applies one operator's decision to the documents.

Every stage works on all its predecessor kept and returns the columns of its input
(secret scans with the redacted text and its new length).  Models and benchmarks
are read from ``sf_dir``; null texts and ids pass as the operators define.
"""

from __future__ import annotations

from .common import read_table
from .decontaminate import drop_contaminated
from .mixing import sample
from .quality import keep_good
from .secrets import redact
from .simhash import drop_near_duplicates


def quality_filter(spark, docs, sf_dir):
    """Documents of poor or toxic grade go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark; every document stays."""
    return redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents drawn so that sources, languages and topics meet their target weights."""
    return sample(docs)

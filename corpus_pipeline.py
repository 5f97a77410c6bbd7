"""The corpus pipeline: STAGES of (name, function) over ``documents``.

Each function takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet to the shared checkpoint folder and reread as the next stage's docs.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave.llm import stages  # noqa: E402
from logweave.llm.common import read_table, stored  # noqa: E402

STAGES = [
    ("quality_classifier", stages.quality_filter),
    ("simhash_dedup", stages.simhash_dedup),
    ("benchmark_decontamination", stages.decontaminate),
    ("secret_scan", stages.redact_secrets),
    ("source_mixing", stages.mix_sources),
]

# Fingerprints and the trained classifier have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs)
    return docs

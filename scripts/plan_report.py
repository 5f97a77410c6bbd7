"""Physical-plan census of every registered query (no execution).

For each query: file scans, shuffles, broadcasts, windows, aggregates, Python
operators, and any cartesian product / nested-loop join (there must be none).
Prints a Markdown table.  Usage: python scripts/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweave.plans.registered import QUERIES  # noqa: E402
from logweave.session import build_session  # noqa: E402

COUNTS = {
    "scans": r"FileScan |Scan parquet|Scan text|Scan ExistingRDD",
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "windows": r"\bWindow \[",
    "aggregates": r"HashAggregate\(|SortAggregate\(|ObjectHashAggregate\(",
    "python": r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
    "nested_loop_or_cartesian": r"BroadcastNestedLoopJoin|CartesianProduct",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[4]", shuffle_partitions=8)
    print("| query | " + " | ".join(COUNTS) + " |")
    print("| --- | " + " | ".join("---" for _ in COUNTS) + " |")
    bad = []
    for name, fn in QUERIES.items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        row = {k: len(re.findall(p, plan)) for k, p in COUNTS.items()}
        if row["nested_loop_or_cartesian"]:
            bad.append(name)
        print(f"| `{name}` | " + " | ".join(str(row[k]) for k in COUNTS) + " |")
    print()
    print("nested-loop / cartesian joins:", ", ".join(bad) if bad else "none")


if __name__ == "__main__":
    main()

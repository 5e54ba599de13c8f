"""Physical-plan summary of every table query -> PLANS.md.

    python tools/plan_report.py [sf_dir] > PLANS.md

Per query: shuffles (hash / range / single-partition exchanges), broadcasts,
join strategies, aggregate and window operators, and whether any Python
evaluation appears.  Queries that write
while being built (merge, staging, streaming, exact sample) are planned on
what they return.
"""
from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.plans.workload import QUERIES  # noqa: E402
from tablewright.session import local_session  # noqa: E402

NODES = [
    ("hash shuffle", r"Exchange hashpartitioning"),
    ("range shuffle", r"Exchange rangepartitioning"),
    ("single-partition", r"Exchange SinglePartition"),
    ("broadcast", r"BroadcastExchange"),
    ("SMJ", r"SortMergeJoin"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SHJ", r"ShuffledHashJoin"),
    ("hash agg", r"HashAggregate"),
    ("sort agg", r"SortAggregate"),
    ("window", r"\bWindow\b"),
    ("window limit", r"WindowGroupLimit"),
    ("top-k", r"TakeOrderedAndProject"),
    ("python", r"(BatchEvalPython|ArrowEvalPython|PythonUDF|InPandas)"),
]


def summary(tree: str) -> str:
    c = Counter()
    for label, pat in NODES:
        n = len(re.findall(pat, tree))
        if n:
            c[label] = n
    return ", ".join(f"{k} {v}" for k, v in c.items()) or "scan/project only"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16)
    print(f"# Physical plans ({os.path.basename(sf_dir)}, AQE initial plans)\n")
    print("Generated by `tools/plan_report.py`. Counts are operator nodes in the physical plan")
    print("before AQE re-optimisation (AQE may still turn a sort-merge join into a broadcast join at run time).\n")
    print("| query | operators |")
    print("|---|---|")
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        print(f"| `{name}` | {summary(plan)} |")


if __name__ == "__main__":
    main()

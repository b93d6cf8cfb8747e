"""Write PLANS.md: the physical plan of every headline query at a given scale, summarised.

Usage: python scripts/plan_report.py [/root/testdata/sf0.1] > PLANS.md
For each query: operator counts of the final adaptive plan (joins, exchanges, windows,
aggregates), the columns each Parquet scan reads and the filters pushed into it.
"""
from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from envlab.plans.registry import QUERIES  # noqa: E402
from envlab.session import get_session  # noqa: E402

HEADLINE = ["support_report", "corpus_a", "corpus_b", "encoded", "eval_report", "head_js", "heads_compact",
            "seed_aggregate", "curve_summary", "loss_moving_avg", "padded", "eval_by_step"]
OPS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "Exchange RoundRobin",
       "Window", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject", "Generate",
       "MapInPandas", "WholeStageCodegen")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    print(f"# Physical plans of the headline queries ({os.path.basename(sf)}, local[8], AQE on)\n")
    print("Generated by `scripts/plan_report.py` from the final adaptive plans after running each query.\n")
    for name in HEADLINE:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = Counter(m for op in OPS for m in re.findall(re.escape(op), plan))
        print(f"## {name}\n")
        print("| operator | count |\n|---|---|")
        for op in OPS:
            if counts.get(op):
                print(f"| {op} | {counts[op]} |")
        scans = re.findall(r"FileScan (\w+) \[([^\]]*)\][^\n]*?PushedFilters: \[([^\]]*)\]", plan)
        if scans:
            print("\n| scan | columns read | pushed filters |\n|---|---|---|")
            for fmt, cols, pushed in scans:
                cols = ", ".join(re.sub(r"#\d+L?", "", c) for c in cols.split(","))
                print(f"| {fmt} | {cols} | {pushed or '-'} |")
        print()


if __name__ == "__main__":
    main()

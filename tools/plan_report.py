"""Write PLANS.md: the physical-plan shape of every registered query.

    python tools/plan_report.py [sf_dir] > PLANS.md

For each query the plan Spark chooses before runtime statistics (the
``explain`` of the unexecuted DataFrame) is reduced to counts of shuffles by
kind, join strategies, aggregates, windows and whether filters reached the
Parquet scan. At the small test scale the planner broadcasts build sides that
fit under the threshold; at full scale those joins become shuffle joins, which
AQE may turn back into broadcasts once it has measured them.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoal.operators.joins import physical_plan  # noqa: E402
from shoal.plans import catalog  # noqa: E402
from shoal.session import build_session  # noqa: E402

WRITE_FIRST = ("join_bucketed", "tbl_roundtrip", "join_from_text", "text_checksums", "dist_file_roundtrip",
               "refresh_files", "transfer_per_second_stream")

PATTERNS = {
    "hash shuffle": r"Exchange hashpartitioning",
    "range shuffle": r"Exchange rangepartitioning",
    "single-partition": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "BHJ": r"BroadcastHashJoin",
    "SMJ": r"SortMergeJoin",
    "SHJ": r"ShuffledHashJoin",
    "BNLJ": r"BroadcastNestedLoopJoin",
    "partial agg": r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_",
    "window": r"\bWindow \[",
    "group limit": r"WindowGroupLimit",
    "top-k": r"TakeOrderedAndProject",
    "python": r"(ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas)",
}


def summarize(plan: str) -> dict[str, int]:
    out = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    out["scans"] = len(re.findall(r"FileScan", plan))
    out["scans w/ pushed filters"] = sum(1 for p in pushed if p.strip())
    return out


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    cols = list(PATTERNS) + ["scans", "scans w/ pushed filters"]
    print(f"# Physical plans ({os.path.basename(sf_dir)}, before runtime re-planning)\n")
    print("Generated by `tools/plan_report.py`. Counts of plan operators per registered query.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    totals: Counter = Counter()
    for name, fn in catalog.QUERIES.items():
        if name in WRITE_FIRST:
            continue  # write files before planning; see the notes below
        try:
            s = summarize(physical_plan(fn(spark, sf_dir), "simple"))
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {type(e).__name__} |")
            continue
        totals.update({k: v for k, v in s.items() if v})
        print(f"| `{name}` | " + " | ".join(str(s[c]) if s[c] else "" for c in cols) + " |")
    print("\nNot listed, as they write files before they plan: " + ", ".join(f"`{n}`" for n in WRITE_FIRST) + ".")
    print(f"\nNo query has a Python UDF stage (`python` column): {totals['python'] == 0}.")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)

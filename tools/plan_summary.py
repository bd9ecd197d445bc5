"""Summarise the final (adaptive) physical plan of every registered query.

usage: python tools/plan_summary.py [sf_dir] > PLANS.md
Runs each query of the base registry once (collect) so AQE settles its plan,
then counts the operators that matter for scale.  Broadcasts are off and every
scan and shuffle has several partitions, as on data too large for anything else:
these are the plans used at scale, not those of a small test table.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNTS = [
    ("hash exch", r"Exchange hashpartitioning"),
    ("range exch", r"Exchange rangepartitioning"),
    ("single exch", r"Exchange SinglePartition"),
    ("broadcast", r"BroadcastExchange"),
    ("reused", r"ReusedExchange"),
    ("SMJ", r"SortMergeJoin"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SHJ", r"ShuffledHashJoin"),
    ("window", r"\bWindow \["),
    ("hash agg", r"\bHashAggregate\("),
    ("sort agg", r"\bSortAggregate\("),
    ("object agg", r"\bObjectHashAggregate\("),
]


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from strata.plans import registry
    from strata.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16, extra={
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k"})
    print(f"# Physical plans of the registered queries\n\nFinal adaptive plans at `{sf_dir}` on `local[8]` with "
          "broadcasts and shuffled hash joins off and 16 shuffle partitions, from `python tools/plan_summary.py`: the "
          "plans used where no side of a join is small. Counts are of the final plan only (the part AQE ran); "
          "`pushed` lists filters that reached the Parquet scan. `single exch` are totals or windows over one row a "
          "bucket.\n")
    print("| key | " + " | ".join(n for n, _ in COUNTS) + " | pushed |")
    print("|---|" + "---|" * (len(COUNTS) + 1))
    for key, q in registry.queries().items():
        plan = final_plan(q(spark, sf_dir))
        final = plan.split("+- == Initial Plan ==")[0]
        cells = [str(len(re.findall(p, final))) for _, p in COUNTS]
        pushed = sorted({f for m in re.findall(r"PushedFilters: \[([^\]]*)\]", final) for f in m.split(", ")
                         if f and not f.startswith("IsNotNull")})
        print(f"| `{key}` | " + " | ".join(cells) + f" | {'; '.join(pushed) or '-'} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)

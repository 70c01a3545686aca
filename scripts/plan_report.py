"""Summarise the physical plan of every registered query (markdown table).

usage: python scripts/plan_report.py [SF_DIR] > PLANS.md-fragment

Per query: shuffles (Exchange hashpartitioning / rangepartitioning / round
robin), single-partition exchanges, broadcasts, join strategies, sorts,
Python stages, and the filters pushed into Parquet scans. Plans are the
initial AQE plans (before run-time re-planning).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from shelfwise.plans.catalog import QUERIES
    from shelfwise.plans.inspect import formatted_plan
    from shelfwise.session import checkpoint_dir, get_spark

    spark = get_spark("local[8]", shuffle_partitions=8, extra_conf={"spark.driver.memory": "8g"})
    checkpoint_dir(spark)
    print("| query | shuffles | single-partition | broadcasts | joins | python | pushed filters |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        plan = formatted_plan(fn(spark, sf_dir))
        tree = plan.split("\n\n")[0]
        shuffles = len(re.findall(r"Exchange\b", tree)) - len(re.findall(r"BroadcastExchange", tree))
        single = len(re.findall(r"Arguments: SinglePartition", plan))
        bcast = len(re.findall(r"BroadcastExchange", tree))
        joins = sorted(set(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|"
                                      r"BroadcastNestedLoopJoin|CartesianProduct)", tree)))
        py = sorted(set(re.findall(r"(FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython|"
                                   r"MapInPandas)", tree)))
        pushed = sorted({f for f in re.findall(r"PushedFilters: \[(.*?)\]", plan)
                         if f and not re.fullmatch(r"(IsNotNull\(\w+\)(, )?)+", f)})
        print(f"| {name} | {shuffles} | {single} | {bcast} | {', '.join(joins) or '–'} | "
              f"{', '.join(py) or '–'} | {'; '.join(pushed) or '–'} |")


if __name__ == "__main__":
    main()

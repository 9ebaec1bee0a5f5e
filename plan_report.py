"""Write PLANS.md: physical-plan facts of every registered key.

    python plan_report.py [sf_dir] > PLANS.md

Per key: shuffles (Exchange), join strategies, window / top-k / aggregate
operators, and every parquet scan's pushed filters and read schema, taken from
the plan Spark would run (before adaptive re-planning). Keys whose work is
Spark ML fitting are listed without a plan.
"""

from __future__ import annotations

import re
import sys

from postpulse import catalog as entry
from postpulse.session import build_session

ML_KEYS = {"dt_rmse", "rf_rmse", "dt_cv", "rf_cv", "tree_summary", "dt_stump", "comment_dt_rmse",
           "comment_rf_rmse", "comment_features"}


def facts(spark, df) -> dict:
    jvm = spark._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = []
    for block in text.split("\n\n"):
        head = block.strip().split("\n", 1)[0]
        if re.match(r"\(\d+\) Scan (parquet|csv|text)", head):
            src = re.search(r"Location: \w+ \[([^\]]+)\]", block)
            pushed = re.search(r"PushedFilters: \[(.*)\]", block)
            schema = re.search(r"ReadSchema: struct<(.*)>", block)
            name = src.group(1).rsplit("/", 1)[-1] if src else "?"
            scans.append((name, pushed.group(1) if pushed else "", schema.group(1) if schema else ""))
    joins = sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                                  r"BroadcastNestedLoopJoin|CartesianProduct)", plan)))
    ops = [o for o in ("Window", "WindowGroupLimit", "TakeOrderedAndProject", "HashAggregate",
                       "Generate", "Subquery", "Union") if o in plan]
    return {"exchanges": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
            + plan.count("Exchange SinglePartition") + plan.count("Exchange RoundRobin"),
            "joins": joins, "ops": ops, "scans": scans}


def main(argv) -> None:
    base = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("plan-report")
    print("# PLANS\n")
    print(f"Physical-plan facts of every registered key on `{base}` (`plan_report.py`).")
    print("Exchanges count shuffles in the plan before adaptive re-planning; AQE may")
    print("still turn a sort-merge join into a broadcast from runtime sizes. Keys that")
    print("run several jobs (round trips, sampling statistics, tree levels) show the")
    print("plan of the DataFrame they return, after the earlier jobs have run.\n")
    print("| key | shuffles | joins | operators | scans: table [pushed filters] (read columns) |")
    print("| --- | --- | --- | --- | --- |")
    for key, fn in entry.queries().items():
        if key in ML_KEYS:
            print(f"| {key} | — | — | Spark ML fit | model table from `events` |")
            continue
        f = facts(spark, fn(spark, base))
        scans = "; ".join(f"{n} [{p}] ({s.replace(':', ' ')})" for n, p, s in f["scans"]) \
            or "checkpointed tables of the earlier jobs"
        print(f"| {key} | {f['exchanges']} | {', '.join(f['joins']) or '—'} | "
              f"{', '.join(f['ops']) or '—'} | {scans} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)

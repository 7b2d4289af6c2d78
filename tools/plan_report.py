"""Summarise the final (adaptive) physical plan of every registered query -> PLANS.md.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
Each core query is executed (collect) and only AQE's final plan is counted: exchanges, join
strategies (incl. AQE skew splits and runtime broadcasts), partial/final aggregates,
windows, and what reached the parquet scans. The notes of the present PLANS.md ("How to read
it", and all from the line "## Per-operator scale notes" on) are carried over.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    count = lambda pat: len(re.findall(pat, plan))
    return {
        "exchanges": count(r"Exchange hashpartitioning") + count(r"Exchange rangepartitioning")
                     + count(r"Exchange SinglePartition"),
        "broadcasts": count(r"BroadcastExchange"),
        "smj": count(r"SortMergeJoin"), "bhj": count(r"BroadcastHashJoin"),
        "shj": count(r"ShuffledHashJoin"), "skew_split": count(r"skew=true"),
        "partial_aggs": count(r"partial_"), "windows": count(r"\bWindow \["),
        "python": count(r"Python|ArrowEval|InPandas"),
        "cartesian": count(r"CartesianProduct|BroadcastNestedLoopJoin"),
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", plan))),
        "single_partition": count(r"SinglePartition"), "anti_joins": count(r"LeftAnti"),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from broodline.plans.queries import QUERIES
    from broodline.session import ensure_checkpoint_dir, get_spark
    here = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(here) as f:
        text = f.read()
    notes = text.partition("## Per-operator scale notes")
    reading = "How to read it:" + text.partition("How to read it:")[2].partition("| query |")[0]
    spark = get_spark(master=os.environ.get("MASTER"), shuffle_partitions=16)
    ensure_checkpoint_dir(spark)
    print(f"# Physical plan summary ({os.path.basename(sf_dir)}, final AQE plans)\n")
    print("Generated by `tools/plan_report.py`. Counts are per query over the final plan (what ran, "
          "not the initial plan) below its last stage cut; staged tables are Parquet scans.\n")
    print(reading, end="")
    cols = ["exchanges", "broadcasts", "smj", "bhj", "shj", "skew_split", "partial_aggs",
            "windows", "single_partition", "python", "cartesian", "codegen_stages", "anti_joins"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---" * (len(cols) + 1) + "|")
    scans = {}
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        s = summarise(plan)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)
        scans[name] = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
    print("\n## Parquet scans (ReadSchema after column pruning)\n")
    for name, rs in scans.items():
        for r in rs:
            print(f"* `{name}`: `{r}`")
    print("\n" + "".join(notes[1:]), end="")


if __name__ == "__main__":
    main()

"""Physical-plan summary per query key: shuffles, join strategies, window limits, scan pruning.

``python -m looplake.plans.explain [keys...] [--sf DIR]`` prints one block per key (built from
the registry, plan taken after AQE's initial planning, without executing the query).
"""

from __future__ import annotations

import re


def summarize(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    count = lambda pat: len(re.findall(pat, plan))
    return {
        "shuffles": count(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition"
                          r"|Exchange RoundRobinPartitioning"),
        "single_partition_exchanges": count(r"Exchange SinglePartition"),
        "broadcasts": count(r"BroadcastExchange"),
        "sort_merge_joins": count(r"SortMergeJoin"),
        "broadcast_hash_joins": count(r"BroadcastHashJoin"),
        "nested_loop_joins": count(r"BroadcastNestedLoopJoin|CartesianProduct"),
        "window_group_limits": count(r"WindowGroupLimit"),
        "take_ordered": count(r"TakeOrderedAndProject"),
        "python_udfs": count(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas"),
        "scans": sorted(set(re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan)))[:20],
        "pushed_filters": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))[:20],
    }


def main(argv=None):
    import argparse
    import json

    from looplake.plans.registry import load_all
    from looplake.session import get_session

    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    a = ap.parse_args(argv)
    spark = get_session("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    for k in a.keys or sorted(reg):
        s = summarize(reg[k].build(spark, a.sf))
        print(json.dumps({"key": k, **{x: y for x, y in s.items() if x not in ("scans", "pushed_filters")}}))


if __name__ == "__main__":
    main()

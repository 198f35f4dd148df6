"""Summarise the executed physical plans of registered queries.

Each query is run, and so is every table that it cuts (``materialize``) while
it is built; the summary shows AQE's final plan of each: exchanges (with the
keys of hash exchanges), join strategies, Python nodes and scanned columns.
Usage: python tools/plan_summary.py [sf_dir] [name ...]
"""
from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from geolex import session  # noqa: E402
from geolex.operators import profiles, tfidf, wordmodel  # noqa: E402
from geolex.plans import catalog, jobs, standins  # noqa: E402

NODES = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "ObjectHashAggregate",
         "SortAggregate", "Window", "WindowGroupLimit", "TakeOrderedAndProject", "Generate", "BatchEvalPython",
         "ArrowEvalPython")


def summary(df) -> str:
    execution = df._jdf.queryExecution()
    execution.toRdd().count()  # runs this very plan, so that AQE has made it final
    plan = execution.executedPlan().toString()
    plan = plan.split("+- == Initial Plan ==")[0]
    counts = Counter()
    for line in plan.splitlines():
        for n in NODES:
            if re.search(rf"(^|[\s\-+:*)]){n}\b", line):
                counts[n] += 1
    keys = Counter(re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))
    scans = sorted(set(re.findall(r"FileScan \w+ \[([^\]]*)\]", plan)))
    final = "" if "isFinalPlan=false" not in plan else " (not final)"
    return (", ".join(f"{k}={v}" for k, v in sorted(counts.items())) + final
            + "\n    exchanged on: " + ("; ".join(f"{k}" + f" x{n}" * (n > 1) for k, n in keys.items()) or "-")
            + "\n    scans: " + " | ".join(re.sub(r"#\d+L?", "", s) for s in scans))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:]
    spark = session.get_spark("local[8]", 16, extra={"spark.ui.showConsoleProgress": "false",
                                                     "spark.driver.memory": "12g"})
    cuts: list[str] = []

    def spy(df, name, real=session.materialize):
        cuts.append(f"  cut {name}: {summary(df)}")
        return real(df, name)

    for module in (session, catalog, profiles, tfidf, wordmodel, jobs, standins):
        if hasattr(module, "materialize"):
            module.materialize = spy
    for name in names or sorted(catalog.queries()):
        cuts.clear()
        last = summary(catalog.queries()[name](spark, sf))
        print("\n".join([f"{name}: {last}", *cuts]))
        session.remove_cuts(spark)


if __name__ == "__main__":
    main()

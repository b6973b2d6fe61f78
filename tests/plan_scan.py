"""Plan properties of registered queries: python tests/plan_scan.py SF_DIR [prefix ...]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def findings(plan: str) -> list[str]:
    out = [w for w in FORBIDDEN if w in plan]
    n = len(re.findall(r"Exchange SinglePartition", plan))
    if n:
        out.append(f"single-partition exchanges: {n}")
    return out


def main() -> None:
    from tests.sessions import session
    import __spark_entry__ as E
    spark, sf = session(), sys.argv[1]
    for name, fn in E.queries().items():
        if len(sys.argv) > 2 and not name.startswith(tuple(sys.argv[2:])):
            continue
        plan = plan_of(fn(spark, sf))
        windows = re.findall(r"Window \[.*?\], \[(.*?)\]", plan)
        bad = findings(plan)
        print(f"{name:40s} shuffles={len(re.findall(r'Exchange hashpartitioning|Exchange rangepartitioning', plan)):3d} "
              f"broadcasts={plan.count('BroadcastExchange'):2d} {bad if bad else ''} {sorted(set(windows))[:3] if '--windows' in sys.argv else ''}", flush=True)


if __name__ == "__main__":
    main()

"""Write PLANS.md: the final adaptive physical plan of the headline queries.

    python tools/explain_plans.py [sf_dir]

Each query is run once (noop sink) so the plan shown is AQE's final plan
(runtime join strategies, coalesced partitions), then trimmed to the
operator tree.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = [
    "momentum", "influence_matrix", "momentum_star", "dedup_cross_feed", "anti_seen", "digest_lines",
    "top_meetings_per_group", "rolling_recent", "upsert_momentum", "parse_meeting_reports", "q_search_topics",
]


def trim(plan: str) -> str:
    from signalmart.functions.scalars import PY_WHITESPACE

    plan = plan.replace(PY_WHITESPACE, "<python-whitespace>")
    out = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        out.append(line if len(line) <= 200 else line[:197] + "...")
    return "\n".join(out)


def main() -> None:
    from signalmart.plans.catalog import QUERIES
    from signalmart.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    parts = ["# Final physical plans\n", f"Generated by `tools/explain_plans.py` at `{sf}` on local[8] (AQE final plans).\n"]
    for k in KEYS:
        df = QUERIES[k](spark, sf)
        df.collect()  # runs this DataFrame's own query execution, so its plan is final
        plan = df._jdf.queryExecution().executedPlan().toString()
        parts.append(f"\n## {k}\n\n```\n{trim(plan)}\n```\n")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("".join(parts))
    print(path)


if __name__ == "__main__":
    main()

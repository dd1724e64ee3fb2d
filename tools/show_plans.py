"""Physical-plan shape of the registered queries.

    python tools/show_plans.py [sf_dir] [name ...]        # table for PLANS.md
    python tools/show_plans.py --explain name [--hot]     # formatted plan of one query

The plans are those that ran: AQE has dropped what hangs on an empty table of hot
groups. Counted with no group hot and with every group of over 15 rows hot: shuffle
Exchanges, Window operators, partial top-k (``WindowGroupLimit``), broadcast and
sort-merge joins, and Python evaluation nodes (always 0).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duelframe.operators.hot import CONF  # noqa: E402
from duelframe.plans import registry  # noqa: E402
from duelframe.session import checkpoint_dir, get_session  # noqa: E402


def shape(plan: str) -> dict:
    lines = [ln.strip(" :+-*()0123456789") for ln in plan.split("== Initial Plan ==")[0].split("\n")]
    return {
        "exchanges": sum(1 for ln in lines if ln.startswith("Exchange ")),
        "windows": sum(1 for ln in lines if ln.startswith("Window ")),
        "topk": sum(1 for ln in lines if ln.startswith("WindowGroupLimit")),
        "bhj": sum(1 for ln in lines if ln.startswith("BroadcastHashJoin")),
        "smj": sum(1 for ln in lines if ln.startswith("SortMergeJoin")),
        "python": plan.count("EvalPython"),
    }


def main(argv):
    spark = get_session("local[8]", 8)
    checkpoint_dir(spark)
    sf = next((a for a in argv[1:] if a.startswith("/")), "/root/testdata/sf0.001")
    qs = registry.QUERIES
    if "--explain" in argv:
        if "--hot" in argv:
            spark.conf.set(CONF, "15")
        qs[argv[argv.index("--explain") + 1]](spark, sf).explain("formatted")
        return
    names = [a for a in argv[1:] if not a.startswith("/") and not a.startswith("--")] or \
        [n for n in qs if n in registry.ORACLES]
    print("| query | exch / win / top-k / bhj / smj | hot groups: exch / win / top-k / bhj / smj |")
    print("|---|---|---|")
    for name in names:
        cells = []
        for hot in (False, True):
            spark.conf.set(CONF, "15" if hot else "2000000")
            df = qs[name](spark, sf)
            df._jdf.queryExecution().toRdd().count()
            s = shape(df._jdf.queryExecution().executedPlan().toString())
            assert s["python"] == 0, name
            cells.append(f"{s['exchanges']} / {s['windows']} / {s['topk']} / {s['bhj']} / {s['smj']}")
        print(f"| `{name}` | {cells[0]} | {cells[1]} |", flush=True)
    spark.conf.unset(CONF)


if __name__ == "__main__":
    main(sys.argv)

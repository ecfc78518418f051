"""Benchmark: wall time of the headline queries.

Runs every query fully (``write.format("noop")``: the whole plan executes, no
rows are collected) on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``; after one warm-up pass each query is timed
``$BENCH_REPEATS`` times (default 3), with the cache cleared before every
run, and the median is reported. Prints one JSON line.

Two inputs: ``ev_*`` queries use the events adapter (SURVEY §5.1, cell
minimum 5), ``li_*`` queries the heavier lineitem adapter (600 rows per
supplier, reference thresholds). ``$BENCH_EVENT_LOG`` (optional) names a
folder for Spark's event log, for stage and task times without the UI.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from risegraph.params import SMALL, Params  # noqa: E402
from risegraph.plans.analysis import Analysis  # noqa: E402
from risegraph.session import build_session  # noqa: E402
from risegraph.sources.adapters import (LINEITEM_ORDER, load_events_submissions,  # noqa: E402
                                        load_lineitem_submissions)


def timed(df) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    event_log = os.environ.get("BENCH_EVENT_LOG")  # a scratch folder for stage/task times (no UI)
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log} if event_log else None
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="risegraph-bench",
                          extra_conf=extra)

    def ev(materialize: bool = False) -> Analysis:
        return Analysis(load_events_submissions(spark, sf_dir), SMALL, materialize=materialize)

    def li(materialize: bool = False) -> Analysis:
        return Analysis(load_lineitem_submissions(spark, sf_dir), Params(order_by=LINEITEM_ORDER),
                        materialize=materialize)

    plans = {
        "ev_user_features": lambda: ev().features,
        "ev_att_significance": lambda: ev().att_significance,
        "ev_survival_effects": lambda: ev().survival_effects,
        "ev_time_to_improve": lambda: ev().time_to_improve,
        "ev_transition_graph": lambda: ev().transition_graph,
        "ev_path_support": lambda: ev().path_support,
        "ev_placebo_bias": lambda: ev().placebo_bias,
        "ev_recommendations": lambda: ev(True).recommendations(significant_only=False),
        "li_user_features": lambda: li().features,
        "li_att_significance": lambda: li().att_significance,
        "li_survival_effects": lambda: li().survival_effects,
        "li_transition_graph": lambda: li().transition_graph,
        "li_path_support": lambda: li().path_support,
        "li_placebo_bias": lambda: li().placebo_bias,
        "li_recommendations": lambda: li(True).recommendations(significant_only=False),
    }
    only = [k for k in os.environ.get("BENCH_ONLY", "").split(",") if k]
    if only:
        plans = {k: v for k, v in plans.items() if k in only}

    for build in plans.values():  # warm-up: JIT, file listing, broadcast paths
        timed(build())
    results = {}
    for name, build in plans.items():
        runs = []
        for _ in range(repeats):
            # no run may read tables cached by an earlier one (identical plans share cache entries)
            spark.catalog.clearCache()
            t = time.perf_counter()
            df = build()  # plan construction (size checks, checkpoints) counts as part of the query
            timed(df)
            runs.append(time.perf_counter() - t)
        results[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "median wall time per query, summed",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": sf,
        "cpus": cpus,
        "repeats": repeats,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM and then three times; the median counts. Beside the
seconds of each query the line holds its rows, the bytes one run shuffles and the number
of exchanges in its plan (those of jobs that run while a query is built are in the bytes).
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation, functions as F  # noqa: E402

from tidepanel import catalog  # noqa: E402
from tidepanel.plans.session import local_session  # noqa: E402

HEADLINE = (
    "g5_industry_overview", "g1_weekly_growth", "g2_daily_growth", "g8_diffusion_daily_pop", "g12_seasonal_week",
    "r1_resample_week_median", "r6_value_align", "m1_missing_profile", "m6_interpolate_linear", "t11_transform_chain",
    "j9_compare_datasets", "j10_same_values_other_name", "j12_asof_value", "s1_load_panel", "s2_vendor_grid_ingest", "f2_infer_frequency",
    "l2_batch_lag_correlation", "l6_lead_lag", "l9_win_rate", "a1_adf_screen", "l8_dtw", "n7_evaluate_model", "n20_industry_r2",
)
#: Slow ones run once after the warm-up.
ONCE = {"n7_evaluate_model"}


def shuffled(spark) -> int:
    """Bytes that all executors have written to shuffles so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    catalog.load_all()
    spark = local_session(cpus, shuffle=int(cpus), app="bench")
    names = sys.argv[1:] or HEADLINE
    out, more = {}, {}
    for name in names:
        runs = []
        for i in range((1 if name in ONCE else repeats) + 1):
            seen, before, t = Observation(), shuffled(spark), time.perf_counter()
            df = catalog.QUERIES[name](spark, sf)
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
            plan = df._jdf.queryExecution().executedPlan().toString()
            more[name] = {"rows": seen.get["rows"], "shuffle_bytes": shuffled(spark) - before, "exchanges": plan.count("Exchange hashpartitioning") + plan.count("Exchange range") + plan.count("Exchange Single")}
        out[name] = round(statistics.median(runs[1:] or runs), 3)
        print(f"# {name} {out[name]} {more[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "panel_headline_total", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": os.path.basename(sf.rstrip("/")), "detail": more}))
    spark.stop()


if __name__ == "__main__":
    main()

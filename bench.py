"""Wall time of the headline queries at ``$BENCH_SF_DIR``; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")  # a task is one core

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a02_unpivot_wide", "a03_unpivot_preagg", "a06_binned_median", "g02_fill_linear", "g03_search_space", "g05_coverage", "g06_coverage_wide",
    "g08_ohlc", "g11_describe_raw", "g12_histogram", "g14_duration_curve", "b11_derive", "j01_join_dim", "j04_interval_overlap", "j12_markers_near",
    "w04_state_episodes", "w06_mine_sequences", "r01_correlation_matrix", "r04_rank_causes", "r11_causality_matrix", "s03_detect_periods",
    "s06_decompose", "d09_decompose_anomalies", "d13_change_point", "c01_subgroups", "c05_rules_nelson", "c06_capability", "f01_forecast",
    "f04_backtest", "f05_measured_bands", "d02_residual_voting", "d03_change_point", "d04_random_projection", "d05_spectral", "x01_similarity_1d",
    "x04_similarity_multidim", "x11_sax_discords", "x16_vsm_classify", "p01_matrix_profile", "p12_chains", "p14_mstamp", "p17_consensus_motif",
    "l01_stream_bins", "l05_collapse_alerts", "entry_deviation_runs",
]
PROFILE_SIZES = (4000, 8000, 12000)
LONGER = 24000  # timed by cores only: the smaller sizes are mostly the fixed cost of a job


def profile_input(spark, n: int):
    """A seeded random walk of ``n`` points as a one-signal grid."""
    import numpy as np
    import pandas as pd

    from signalmill.functions.ordered import mark_bins

    walk = np.cumsum(np.random.default_rng(7).standard_normal(n))
    pdf = pd.DataFrame({"signal_id": "x", "bin_idx": np.arange(n), "value": walk})
    return mark_bins(spark.createDataFrame(pdf), n)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark import cloudpickle

    import signalmill

    cloudpickle.register_pickle_by_value(signalmill)
    from signalmill.operators.profile import matrix_profile
    from signalmill.plans.all_queries import QUERIES, run
    from signalmill.plans.runtime import build_session

    def session(count: str):
        spark = build_session(
            "bench",
            f"local[{count}]",
            **{"spark.sql.shuffle.partitions": count, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
        )
        spark.sparkContext.setLogLevel("ERROR")
        return spark

    spark = session(cpus)
    names = sys.argv[1:] or HEADLINE
    names = sorted(QUERIES) if names == ["all"] else names
    run("g01_make_series", spark, folder).write.format("noop").mode("overwrite").save()  # start the workers
    run("s01_spectrum", spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        run(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    cores: dict[str, dict[str, float]] = {}
    if not sys.argv[1:]:
        for count in (cpus, *(c for c in ("1", "2", "4", "8") if c != cpus)):
            spark = session(count)
            profile_input(spark, 2000).count()  # start the workers
            matrix_profile(profile_input(spark, 2000), 200).write.format("noop").mode("overwrite").save()
            cores[count] = {}
            for n in (*PROFILE_SIZES, LONGER):
                grid = profile_input(spark, n)
                begin = time.perf_counter()
                matrix_profile(grid, 200).write.format("noop").mode("overwrite").save()
                cores[count][f"mp_n{n}_m200"] = round(time.perf_counter() - begin, 3)
            spark.stop()
        times |= {k: v for k, v in cores[cpus].items() if str(LONGER) not in k}
    else:
        spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale, "profile_by_cores": cores}))


if __name__ == "__main__":
    main()

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark import cloudpickle

    import signalmill
    from signalmill.plans.runtime import build_session

    cloudpickle.register_pickle_by_value(signalmill)
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.streaming.stateStore.numPartitions": "2"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid_of(spark):
    """Grid DataFrame of named NumPy series (NaN means missing)."""
    import numpy as np
    import pandas as pd

    def build(series: dict, keys=("signal_id",), known=True):
        from pyspark.sql import functions as F

        from signalmill.functions.ordered import mark_bins

        parts = []
        for name, values in series.items():
            names = (name,) if isinstance(name, str) else name
            part = pd.DataFrame({"bin_idx": np.arange(len(values)), "value": np.asarray(values, dtype=float)})
            for k, n in zip(keys, names):
                part[k] = n
            parts.append(part)
        df = spark.createDataFrame(pd.concat(parts)[[*keys, "bin_idx", "value"]])
        df = df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
        df = df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,bin_idx,0,0)"))
        longest = max(len(v) for v in series.values())
        return mark_bins(df, longest) if known else df

    return build

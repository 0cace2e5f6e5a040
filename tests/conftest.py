import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelcast.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


PANEL_SCHEMA = "series_id string, timestamp timestamp_ntz, value double, frequency string"


@pytest.fixture(scope="session")
def make_panel(spark):
    """Panel from {series_id: values} (NaN = missing), one row per step, or from (timestamps, values)."""

    def build(series, frequency="Daily", start="2020-01-01"):
        freq = {"Daily": "D", "Hourly": "h", "Weekly": "W", "Monthly": "MS", "Quarterly": "QS", "Yearly": "YS"}[frequency]
        frames = []
        for name, values in series.items():
            if isinstance(values, tuple):
                stamps, values = values
            else:
                stamps = pd.date_range(start, periods=len(values), freq=freq)
            frames.append(pd.DataFrame({"series_id": name, "timestamp": stamps, "value": np.asarray(values, dtype=float)}))
        pdf = pd.concat(frames) if frames else pd.DataFrame({"series_id": [], "timestamp": [], "value": []})
        rows = [
            (r.series_id, r.timestamp.to_pydatetime(), None if np.isnan(r.value) else float(r.value), frequency)
            for r in pdf.itertuples()
        ]
        return spark.createDataFrame(rows, PANEL_SCHEMA)

    return build


def by_id(df, key="series_id"):
    return {r[key]: r for r in df.collect()}

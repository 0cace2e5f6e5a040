"""Functions that run inside tasks must load where this package is not installed."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from panelcast.operators import arima, arima_likelihood, long_trees, ols, smoothing, trees, unit_root

FUNCTIONS = [
    unit_root._adf_grams,
    unit_root._adf_statistics,
    ols._fits,
    smoothing._whole_series,
    smoothing._chunk_summaries,
    arima._long_grams,
    arima._long_fits,
    arima._short_grams(3, 3),
    arima._choose(3, 3),
    arima_likelihood._whole(1, 1),
    arima_likelihood._summaries(None, {}, 1, 10),
    trees._fit(trees.PRESETS, 1),
    long_trees._coded({}),
    long_trees._predicted({}, "x", {}, {}, 0.1),
]


@pytest.mark.parametrize("function", FUNCTIONS, ids=lambda f: f.__qualname__)
def test_loads_without_the_package(function, tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(function))
    code = "from pyspark import cloudpickle; list(cloudpickle.load(open('f', 'rb'))([]))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": ""}, timeout=60)

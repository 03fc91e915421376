"""What the wavelet queries search, against transforms by numpy alone."""

import numpy as np

from tests.conftest import DATA
from wavegrid.operators import cwt
from wavegrid.plans import queries

SF = f"{DATA}/sf0.001"


def test_cwt_freq_hz_searches_twelve_of_sixteen_scales(spark):
    """Four scales to an octave, of which places 2 to 13 are searched, for every pixel and frame of both channels."""
    scales = [(20 ** (1 / 3)) / np.pi * 2 ** (k / 4) for k in range(16)]
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    v = np.array([np.asarray(r[1], float)[::2] for r in rows])
    w = np.abs(cwt.transform(v - v.mean(axis=1, keepdims=True), scales, padding=None))[:, 2:14]
    hz = 20 ** (1 / 3) / np.array(scales[2:14]) / (2 * np.pi) * 2
    want = {(r.vec_id // 25, r.vec_id % 25, t): hz[k] for r, best in zip(rows, w.argmax(axis=1), strict=True) for t, k in enumerate(best)}
    got = queries.QUERIES["cwt_freq_hz"](spark, SF).collect()
    assert len(got) == 2 * len(want) == 2 * 32 * len(rows)
    assert all(abs(r.value - want[r.x, r.y, r.t]) < 1e-6 for r in got)
    assert len({r.value for r in got}) > 6

"""Masked means of token vectors."""

import numpy as np
import pytest

from retort.operators import pooling


def test_masked_mean(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(-9, 9, 4).astype(float).tolist(), int(rng.integers(0, 2))) for k in ["a", "b", "c", None] * 50] + [("d", [1.0] * 4, 0), ("e", None, 1), ("e", [2.0, 4.0, 6.0, 8.0], 1), ("f", [1.0] * 4, None), ("a", [float("nan")] * 4, 0)]
    df = spark.createDataFrame(rows, "key string, vector array<double>, mask int").repartition(5)
    got = {r["key"]: (r["n"], r["mean"]) for r in pooling.masked_mean(df, 4).collect()}
    for k in {r[0] for r in rows}:
        own = [v for key, v, m in rows if key == k and m and v is not None]
        assert got[k][0] == len(own) and (got[k][1] is None if not own else np.allclose(got[k][1], np.mean(own, axis=0)))
    with pytest.raises(Exception, match="numbers"):
        pooling.masked_mean(df, 3).collect()
    assert pooling.masked_mean(df.limit(0), 4).count() == 0

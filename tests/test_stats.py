import numpy as np
import pytest
from pyspark.sql import functions as F

from stationgrid.functions.stats import exact_quantiles, medians, value_at_rank, values_at_ranks


@pytest.mark.parametrize("kind", ["uniform", "skewed", "ties", "huge_range"])
def test_refined_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.uniform(-5, 5, 5000),
        "skewed": np.exp(rng.normal(0, 6, 5000)),
        "ties": rng.integers(0, 4, 5000).astype(float),
        "huge_range": np.append(rng.normal(0, 1e-6, 4999), 1e12),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probabilities = [0.0, 0.5, 0.77]
    got = exact_quantiles(df, ["v"], probabilities, buffer_rows=10)["v"]
    assert np.allclose(got, np.quantile(values, probabilities), rtol=1e-12, atol=0)
    assert value_at_rank(df, "v", 123) == np.sort(values)[123]


def test_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    assert medians(df, ["a", "b"]) == {"a": 2.5, "b": 0.0}
    assert value_at_rank(df, "b", 0) is None
    assert exact_quantiles(df.withColumn("c", F.lit(2.0)), ["c"], [0.5], buffer_rows=1)["c"] == [2.0]


def test_columns_and_ranks_share_their_passes(spark):
    rng = np.random.default_rng(9)
    values = np.stack([rng.normal(0, 1, 3000), rng.integers(0, 3, 3000).astype(float), np.exp(rng.normal(0, 4, 3000))], axis=1)
    df = spark.createDataFrame([tuple(map(float, v)) for v in values], "a double, b double, c double")
    ordered = np.sort(values, axis=0)
    assert values_at_ranks(df, {"a": 10, "b": 2999, "c": 1500}) == {"a": ordered[10, 0], "b": ordered[2999, 1], "c": ordered[1500, 2]}
    assert values_at_ranks(df, {"a": 3000, "b": 0}) == {"a": None, "b": ordered[0, 1]}
    got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.5], buffer_rows=10)
    for i, c in enumerate("abc"):
        assert np.allclose(got[c], np.quantile(values[:, i], [0.25, 0.5, 0.5]))

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from credora.operators.quantile import exact_quantiles

values = st.lists(st.one_of(st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=300)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, select_rows=st.sampled_from([5, 40, 10_000]))
def test_exact_quantiles_property(spark, vals, select_rows):
    """Any data (ties, a repeated value, tiny groups) and either path gives NumPy's
    linear-interpolation quantiles."""
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "v", probs, select_rows=select_rows).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12, abs=1e-9)

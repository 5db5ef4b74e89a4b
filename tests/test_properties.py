"""Property tests: the exact split against brute force on random inputs."""

import hashlib
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vintner.operators.split import exact_split


@settings(max_examples=12, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.sets(st.integers(min_value=-10**12, max_value=10**12), min_size=1, max_size=300),
       fraction=st.sampled_from([0.1, 0.25, 0.5, 0.9]),
       seed=st.integers(min_value=0, max_value=99),
       parts=st.integers(min_value=1, max_value=6))
def test_exact_split_property(spark, keys, fraction, seed, parts):
    keys = sorted(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
    got = {r.k for r in exact_split(df, "k", fraction, seed).where("is_test").collect()}
    ordered = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    assert got == set(ordered[:math.ceil(fraction * len(keys))])

import random

import pytest
from pyspark.sql import functions as F

from wardspark.operators import metrics


@pytest.mark.parametrize("kind", ["spread", "close", "ties", "negative", "one"])
def test_exact_ranks_equal_a_sort(spark, kind):
    draw = random.Random(5)
    values = {
        "spread": [draw.expovariate(1) * 10 ** draw.randint(-6, 6) for _ in range(2000)],
        "close": [1.0 + draw.random() / 1000 for _ in range(2000)],  # all in one slot
        "ties": [draw.choice([0.0, 0.25, 3.0]) for _ in range(500)],
        "negative": [draw.gauss(0, 5) for _ in range(1000)],
        "one": [7.5],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    quantiles = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {r.quantile: r.value for r in metrics.exact_ranks(df, "v", quantiles).collect()}
    assert got == {q: sorted(values)[int((len(values) - 1) * q)] for q in quantiles}


def test_ttft_and_check_buckets(spark):
    timing = spark.createDataFrame([("a", 5_000), ("a", 200_000), ("a", None), ("b", 9_000_000)], "kind string, ttft_us long")
    rows = metrics.ttft_histogram(timing, ["kind"]).filter(F.col("le") == 0.01).collect()
    assert {r.kind: (r.cumulative, r.total) for r in rows} == {"a": (1, 2), "b": (0, 1)}
    checks = spark.createDataFrame([("a", 0.0004), ("a", 0.2)], "kind string, s double")
    last = metrics.check_histogram(checks, "s", ["kind"]).filter(F.col("le") == float("inf")).first()
    assert (last.cumulative, last.total) == (2, 2)


def test_blocks_have_three_stages(spark):
    rows = [("t", "/v1/complete", "guardrail_block"), ("t", "/v1/stream", "output_policy_violation"),
            ("t", "/v1/complete", "output_policy_violation"), ("t", "/v1/stream", None)]
    df = spark.createDataFrame(rows, "tenant_id string, path string, error string")
    got = {(r.stage, r.n) for r in metrics.blocks_total(df).collect()}
    assert got == {("input", 1), ("output", 1), ("output_sync", 1)}


def test_merged_sketches_are_within_their_error(spark):
    draw = random.Random(6)
    rows = [("wide", day, draw.expovariate(1) * 10 ** draw.randint(-9, 9)) for day in range(3) for _ in range(700)]
    rows += [("zeros", day, draw.choice([0.0, 0.0, -2.0, 4.0])) for day in range(2) for _ in range(100)]
    rows += [("one", 0, 7.5), ("one", 1, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "tenant string, day int, v double")
    quantiles = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    sketches = metrics.latency_sketches(df, "v", ["tenant", "day"], 0.02)
    got = {(r.tenant, r.quantile): (r.n, r.value) for r in
           metrics.approximate_ranks(sketches, ["tenant"], quantiles, 0.02).collect()}
    assert {tenant for tenant, _ in got} == {"wide", "zeros", "one"}
    for (tenant, q), (n, value) in got.items():
        values = sorted(v for t, _, v in rows if t == tenant and v is not None)
        exact = max(values[int((len(values) - 1) * q)], 0.0)
        assert n == len(values) and abs(value - exact) <= 0.0201 * exact, (tenant, q)
    whole = metrics.latency_sketches(df, "v", ["tenant"], 0.02)
    merged = metrics.merge_sketches(sketches, ["tenant"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardspark import workload as W
from wardspark.functions.rules import RULE_SCHEMA
from wardspark.operators import admission, quota


def plain_limit(rows, limit, window_us):
    logs, out = {}, {}
    for tenant, us, rid in sorted(rows):
        log = [t for t in logs.get(tenant, []) if t > us - window_us]
        if len(log) < limit:
            log.append(us)
            out[rid] = (True, limit - len(log))
        else:
            out[rid] = (False, 0)
        logs[tenant] = log
    return out


def request_frame(spark, rows):
    df = spark.createDataFrame(rows, "tenant_id string, us long, request_id long")
    return df.withColumn("ts", F.timestamp_micros("us"))


@pytest.mark.parametrize("seed,limit,chunk_rows,slots", [
    (1, 3, 1_000_000, 60), (2, 5, 100, 10), (3, 1, 150, 1),
])
def test_limit_equals_plain_fold(spark, seed, limit, chunk_rows, slots):
    rng = random.Random(seed)
    rows, rid = [], 0
    for tenant in "abcd":
        t = 1_000_000_000
        for _ in range(rng.randint(40, 90)):
            t += rng.choice([0, 0, 1, 100_000, 1_000_000, 9_999_999, 10_000_000, 10_000_001, 25_000_000])
            rows.append((tenant, t, rid))
            rid += 1
    # One tenant holds most rows, many at the same time.
    for _ in range(400):
        rows.append(("hot", 1_000_000_000 + rng.randint(0, 400) * 250_000, rid))
        rid += 1
    got = admission.admit(
        request_frame(spark, rows), limit, 10.0, chunk_rows=chunk_rows, slots_per_window=slots
    )
    assert {r.request_id: (r.admitted, r.remaining) for r in got.collect()} == plain_limit(
        rows, limit, 10_000_000
    )


def test_limit_boundary(spark):
    rows = [("a", 0, 1), ("a", 1, 2), ("a", 9_999_999, 3), ("a", 10_000_000, 4), ("a", 10_000_001, 5)]
    got = {r.request_id: r.admitted for r in admission.admit(request_frame(spark, rows), 2, 10.0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def usage_rows(rng, n=150):
    return [
        (rng.choice(["a", "b"]), 86_399_000_000 + rng.randint(0, 40) * 100_000, rid,
         rng.choice([0, 0, 5, 10, 40]), rng.randint(0, 100) / 100, rng.choice(["m1", "M2"]))
        for rid in range(n)
    ]


def usage_frame(spark, rows):
    df = spark.createDataFrame(
        rows, "tenant_id string, us long, request_id long, tokens long, score double, model string"
    )
    return df.withColumn("ts", F.timestamp_micros("us"))


def test_quota_equals_plain_fold(spark):
    rows = usage_rows(random.Random(5))
    used, want = {}, {}
    for tenant, us, rid, tokens, *_ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        day = us // 86_400_000_000
        total = used.get((tenant, day), 0)
        want[rid] = (total if total < 200 else None, total < 200)
        if total < 200:
            used[(tenant, day)] = total + tokens
    got = quota.daily_quota(usage_frame(spark, rows), 200)
    assert {r.request_id: (r.used_before, r.quota_ok) for r in got.collect()} == want


RULES = [
    ("a", "v", 0, "early", [(None, "tenant.daily_tokens", "<", 50.0, []),
                            ("AND", "input.risk_score", ">", 0.7, [])], "BLOCK", ""),
    ("a", "v", 1, "exact", [(None, "tenant.daily_tokens", "==", 60.0, [])], "block", ""),
    ("a", "v", 2, "model", [(None, "request.model", "==", None, ["m2"]),
                            ("OR", "tenant.daily_tokens", ">", 120.0, []),
                            ("AND", "input.risk_score", ">", 0.5, [])], "BLOCK", ""),
    ("a", "v", 3, "rest", [(None, "request.model", "NOT_IN", None, [])], "TAG", ""),
]


def plain_rule(score, model, used):
    if used < 50 and score > 0.7:
        return "early", "BLOCK"
    if used == 60:
        return "exact", "BLOCK"
    if (model.lower() == "m2" or used > 120) and score > 0.5:
        return "model", "BLOCK"
    return "rest", "TAG"


@pytest.mark.parametrize("chunk_rows", [1_000_000, 60])
def test_quota_with_token_rules_equals_plain_fold(spark, chunk_rows):
    rows = usage_rows(random.Random(11), 200)
    used, want = {}, {}
    for tenant, us, rid, tokens, score, model in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        key = (tenant, us // 86_400_000_000)
        total = used.get(key, 0)
        if total >= 200:
            want[rid] = (None, False, 0, None)
            continue
        name, action = plain_rule(score, model, total) if tenant == "a" else (None, None)
        cost = 0 if action == "BLOCK" else tokens
        used[key] = total + cost
        want[rid] = (total, True, cost, name)
    rules = spark.createDataFrame([(*r, None) for r in RULES], RULE_SCHEMA)
    got = quota.quota_policy_fold(usage_frame(spark, rows), rules, 200, chunk_rows=chunk_rows)
    assert {
        r.request_id: (r.used_before, r.quota_ok, r.charged, r.policy_rule) for r in got.collect()
    } == want


def test_charge(spark):
    df = spark.createDataFrame(
        [("abcdefgh", "ab", 0, 0), ("é" * 8, "", 0, 0), ("", "", 0, 0), ("x", "y", 3, 4)],
        "prompt string, text string, i long, o long",
    )
    costs = df.select(quota.charge(F.col("prompt"), F.col("text"), F.col("i"), F.col("o")).alias("n"))
    assert [r.n for r in costs.collect()] == [2, 4, 1, 7]


def test_rounds_do_not_read_the_input_again(spark):
    """The input is read as often for two rounds as for many."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [("hot", 1_700_000_000_000_000 + i * 100_000, i, 0.5, "m", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "tenant_id string, us long, request_id long, score double, model string, tokens long")
    source = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    source = source.mapInPandas(counted, source.schema)
    seen = []
    for chunk_rows in (250, 20):
        before = read.value
        admission.admit(source.select("tenant_id", "ts", "request_id"), 3, 1.0, chunk_rows=chunk_rows).collect()
        seen.append(read.value - before)
    assert seen[0] == seen[1]
    seen = []
    for chunk_rows in (250, 20):
        before = read.value
        quota.quota_policy_fold(source, W.policy_rules(spark), 300, chunk_rows=chunk_rows).collect()
        seen.append(read.value - before)
    assert seen[0] == seen[1]


def test_fold_takes_batches_one_at_a_time():
    """A chunk is never held whole: what a batch admits leaves before the next one is read."""
    names, read = ["_tenant", "_pack", "_us", "request_id", "_past"], []

    def batches():
        for times in ([0, 10, 20], [30, 105, 110], [111]):
            read.append(times)
            n = len(times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["a"] * n), pa.array([0] * n), pa.array(times), pa.array(times), pa.array([False] * n)],
                names,
            )

    seen, admitted = [], []
    for out in admission._folder(2, 100)(batches()):
        seen.append(len(read))
        admitted += zip(out.column("_us").to_pylist(), out.column("_left").to_pylist())
    assert seen == [1, 2, 3]
    assert admitted == [(0, 1), (10, 0), (105, 0), (110, 0)]


def test_contested_rows_alike_in_time_and_id(spark):
    """Of rows alike in tenant, time and id as many are admitted as there is room for."""
    rows = [("a", 0, 1, f"p{k}") for k in range(5)] + [("a", 0, None, "q")]
    made = spark.createDataFrame(rows, "tenant_id string, us long, request_id long, note string")
    out = admission.admit(made.withColumn("ts", F.timestamp_micros("us")), 3, 60.0).collect()
    assert sorted(r.remaining for r in out if r.admitted) == [0, 1, 2]
    assert sorted(r.note for r in out) == ["p0", "p1", "p2", "p3", "p4", "q"]
    assert not [r for r in out if r.request_id is None and r.admitted]


def test_quota_fold_takes_batches_one_at_a_time():
    """The day's total goes from batch to batch; no chunk is held whole."""
    read = []

    def batches():
        for tokens in ([5, 10], [20], [1, 1]):
            read.append(tokens)
            n = len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array([[]] * n, pa.list_(pa.float64())), pa.array([[False]] * n), pa.array([3] * n)],
                ["tokens", "_bounds", "_blocked", "_used"],
            )

    seen, before = [], []
    for out in quota._folder(30)(batches()):
        seen.append(len(read))
        before += out.column("used_before").to_pylist()
    assert seen == [1, 2, 3]
    assert before == [3, 8, 18, None, None]

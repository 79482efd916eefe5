import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wardspark.functions.rules import RULE_SCHEMA
from wardspark.operators import fold_tree, quota


def plain_total(total, tokens, blocked, bounds, limit):
    """Request by request; range 2i lies below bound i, range 2i + 1 is bound i itself."""
    for cost, row in zip(tokens, blocked):
        if total >= limit:
            return limit
        place = sum(b < total for b in bounds)
        total += 0 if row[2 * place + (total in bounds)] else cost
    return min(total, limit)


@st.composite
def chunks(draw):
    limit = draw(st.integers(0, 60))
    bounds = sorted(draw(st.sets(st.sampled_from([-3.0, 0.0, 1.0, 7.5, 8.0, 20.0, 21.0, 30.25, 59.0, 60.0, 99.0]), max_size=4)))
    ranges = 2 * len(bounds) + 1
    parts = draw(st.lists(st.lists(
        st.tuples(st.sampled_from([0, 1, 2, 5, 40]), st.lists(st.booleans(), min_size=ranges, max_size=ranges)),
        min_size=1, max_size=8), min_size=1, max_size=5))
    return limit, bounds, parts


@settings(max_examples=300, deadline=None)
@given(chunks())
def test_maps_and_their_compositions_equal_the_fold(case):
    limit, bounds, parts = case
    joined, all_tokens, all_blocked = None, [], []
    for part in parts:
        tokens, blocked = np.array([p[0] for p in part]), np.array([p[1] for p in part])
        mapping = fold_tree.chunk_map(tokens, blocked, np.array(bounds), limit)
        for total in range(limit + 1):
            assert fold_tree.value_at(mapping, total, limit) == plain_total(total, tokens, blocked, bounds, limit)
        joined = mapping if joined is None else fold_tree.compose(joined, mapping, limit)
        all_tokens += tokens.tolist()
        all_blocked += blocked.tolist()
    for total in range(limit + 1):
        assert fold_tree.value_at(joined, total, limit) == plain_total(total, all_tokens, all_blocked, bounds, limit)
    assert (joined[1][1:] != joined[1][:-1]).all() and (np.diff(joined[0]) > 0).all()


def test_a_map_of_a_long_chunk_is_as_small_as_its_limit():
    rng = np.random.default_rng(4)
    tokens, blocked = rng.integers(0, 50, 200_000), rng.random((200_000, 5)) < 0.3
    low, shift = fold_tree.chunk_map(tokens, blocked, np.array([400.0, 900.0]), 1000)
    assert len(low) == len(shift) <= 1000


@pytest.mark.parametrize("limit", [300, 2500])
def test_64_chunks_take_few_rounds(spark, monkeypatch, limit):
    """One busy tenant-day in 64 chunks and a quiet one; the fold is the plain one."""
    written = []

    def counted(df, name, write=quota.write_stage):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(quota, "write_stage", counted)
    monkeypatch.setattr(fold_tree, "write_stage", counted)
    rng = np.random.default_rng(8)
    rows = [("hot", i * 1_000_000, i, int(rng.integers(0, 9)), float(rng.random()), "m") for i in range(640)]
    rows += [("calm", i * 1_000_000, 640 + i, 50, 0.9, "m") for i in range(9)]
    rules = spark.createDataFrame([
        ("hot", "v", 0, "early", [(None, "tenant.daily_tokens", "<", 200.0, []), ("AND", "input.risk_score", ">", 0.6, [])], "BLOCK", "", None),
        ("hot", "v", 1, "late", [(None, "tenant.daily_tokens", ">", 1200.0, []), ("AND", "input.risk_score", "<", 0.5, [])], "BLOCK", "", None),
    ], RULE_SCHEMA)
    df = spark.createDataFrame(
        rows, "tenant_id string, us long, request_id long, tokens long, score double, model string"
    ).withColumn("ts", F.timestamp_micros("us"))
    got = {r.request_id: (r.used_before, r.charged) for r in
           quota.quota_policy_fold(df, rules, limit, chunk_rows=10).collect()}
    used, want = {"hot": 0, "calm": 0}, {}
    for tenant, _, rid, tokens, score, _ in rows:
        total = used[tenant]
        blocks = tenant == "hot" and ((total < 200 and score > 0.6) or (total > 1200 and score < 0.5))
        cost = 0 if total >= limit or blocks else tokens
        want[rid] = (None if total >= limit else total, cost)
        used[tenant] = total + cost
    assert got == want
    assert len(written) <= 8, written

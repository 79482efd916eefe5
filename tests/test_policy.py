import datetime as dt
import random

import pytest

from wardspark import workload as W
from wardspark.functions.rules import RULE_SCHEMA, Atom, Rule
from wardspark.operators import policy, quota

CONTEXT = "request_id long, tenant_id string, score double, model string, daily_tokens double"


def rule_frame(spark, rules, tenant="a"):
    rows = [
        (tenant, "v", i, r.rule_name,
         [(a.connective, a.field, a.op, a.num_value, list(a.str_values)) for a in r.atoms], r.action, r.reason, None)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def both(spark, rules, contexts):
    df = spark.createDataFrame([(i, "a", *c) for i, c in enumerate(contexts)], CONTEXT)
    fixed = {r.request_id: r.rule_name for r in policy.evaluate_policy(df, rules).collect()}
    joined = {
        r.request_id: r.rule_name
        for r in policy.evaluate_tenant_policies(df, rule_frame(spark, rules)).collect()
    }
    assert fixed == joined
    return [fixed[i] for i in range(len(contexts))]


def test_single_rules(spark):
    risk = [Rule("r", (Atom("input.risk_score", ">", 0.6),))]
    assert both(spark, risk, [(0.85, "m", 0.0), (0.05, "m", 0.0), (0.6, "m", 0.0)]) == ["r", None, None]
    model = [Rule("r", (Atom("request.model", "==", str_values=("gpt-4",)),))]
    assert both(spark, model, [(0.0, "GPT-4", 0.0), (0.0, "llama-3", 0.0)]) == ["r", None]
    tokens = [Rule("r", (Atom("tenant.daily_tokens", ">", 50000.0),))]
    assert both(spark, tokens, [(0.0, "m", 75000.0), (0.0, "m", 10000.0)]) == ["r", None]


def test_first_rule_wins(spark):
    rules = [Rule("block", (Atom("input.risk_score", ">", 0.6),)),
             Rule("tag", (Atom("input.risk_score", ">", 0.1),), "TAG")]
    assert both(spark, rules, [(0.75, "m", 0.0), (0.3, "m", 0.0)]) == ["block", "tag"]


def test_left_association_and_empty_list(spark):
    rules = [
        Rule("left", (
            Atom("request.model", "==", str_values=("x",)),
            Atom("input.risk_score", ">", 0.5, connective="OR"),
            Atom("tenant.daily_tokens", "<", 10.0, connective="AND"),
        )),
        Rule("all", (Atom("request.model", "NOT_IN"),), "LOG"),
    ]
    contexts = [(0.0, "x", 50.0), (0.9, "y", 5.0), (0.0, "x", 5.0)]
    assert both(spark, rules, contexts) == ["all", "left", "left"]


def test_hundred_rules(spark):
    rules = [Rule(f"r{i}", (Atom("input.risk_score", ">", round(0.9 + i / 1000, 2)),)) for i in range(100)]
    assert both(spark, rules, [(0.1, "m", 0.0), (0.95, "m", 0.0)]) == [None, "r0"]


def test_hits_add_up(spark):
    rng = random.Random(1)
    rules = W.TENANT_RULES["click"]
    contexts = [(i, "a", rng.random(), rng.choice(W.MODELS), rng.random() * 2000) for i in range(300)]
    df = spark.createDataFrame(contexts, CONTEXT)
    hits = policy.rule_hits(df, rule_frame(spark, rules)).collect()
    matched = policy.evaluate_policy(df, rules).filter("matched").count()
    assert sum(r.n_won for r in hits) == matched
    assert all(r.n_held == r.n_won + r.n_shadowed for r in hits)


def test_faulty_rules(spark):
    def row(order, field, op, num, action="BLOCK", version="v1", day=2):
        at = dt.datetime(2024, 1, day, tzinfo=dt.UTC)
        return ("a", version, order, f"r{order}", [(None, field, op, num, ["m"])], action, "", at)

    rows = [
        row(0, "input.risk_score", ">", 0.5), row(1, "request.size", ">", 1.0),
        row(2, "request.model", ">", None), row(3, "input.risk_score", "NOT_IN", None),
        row(4, "tenant.daily_tokens", "<", None), row(5, "request.model", "NOT_IN", None, "drop"),
        row(6, "request.model", "==", None, "redact"), row(7, "input.risk_score", ">=", 0.5),
        row(0, "input.risk_score", ">", 0.5, version="v0", day=1),
    ]
    df = spark.createDataFrame(rows, RULE_SCHEMA)
    faults = {r.rule_order: r.fault for r in policy.rule_table_check(df).collect()}
    assert faults == {
        1: "unknown_field", 2: "unsupported_op", 3: "not_in_on_number", 4: "not_a_number",
        5: "unknown_action", 7: "unsupported_op",
    }
    live = policy.live_versions(df).first()
    assert (live.live_version, live.newest_version, live.n_rejected) == ("v0", "v1", 1)


def test_strict_checks(spark):
    def row(order, atoms, action="TAG"):
        return ("a", f"v{order}", order, f"r{order}", atoms, action, "", None)

    good = ("input.risk_score", ">", 0.5, None)
    rows = [
        row(0, [(None, *good), ("AND", *good)]), row(1, [(None, "input.risk_score", None, 0.5, None)]), row(2, []),
        row(3, [(None, "request.model", "==", None, [])]), row(4, [(None, *good), ("XOR", *good)]),
        row(5, [(None, *good), (None, *good)]), row(6, None), row(7, [(None, *good)], None),
    ]
    faults = {r.rule_order: r.fault for r in policy.rule_table_check(spark.createDataFrame(rows, RULE_SCHEMA)).collect()}
    assert faults == {
        1: "unsupported_op", 2: "no_condition", 3: "no_value", 4: "unknown_connective", 5: "unknown_connective",
        6: "no_condition", 7: "unknown_action",
    }


def test_newest_accepted_version_is_in_force(spark):
    def version(name, day, bound, op=">"):
        at = dt.datetime(2024, 1, day, tzinfo=dt.UTC)
        return ("a", name, 0, name, [(None, "input.risk_score", op, bound, None)], "BLOCK", "", at)

    rules = spark.createDataFrame([version("v1", 1, 0.5), version("v2", 2, 0.9), version("v3", 3, 0.1, "~")], RULE_SCHEMA)
    asked = spark.createDataFrame([(1, "a", 0.7, "m", 0.0), (2, "a", 0.95, "m", 0.0)], CONTEXT)
    judged = {r.request_id: r.rule_name for r in policy.evaluate_tenant_policies(asked, rules).collect()}
    assert judged == {1: None, 2: "v2"}
    assert [(r.rule_name, r.n_held) for r in policy.rule_hits(asked, rules).collect()] == [("v2", 1)]


def test_forced_model(spark):
    rules = rule_frame(spark, [Rule("r", (Atom("request.model", "==", str_values=("mock",)),))])
    asked = spark.createDataFrame([(1, "a", 0.7, "other", 0.0)], CONTEXT)
    assert policy.evaluate_tenant_policies(asked, rules).first().rule_name is None
    assert policy.evaluate_tenant_policies(asked, rules, force_model="Mock").first().rule_name == "r"


def test_a_doubled_key_does_not_double_requests(spark):
    from wardspark.operators import access

    tenants = spark.createDataFrame([("k", "b", "B"), ("k", "a", "A")], "api_key string, tenant_id string, tenant_name string")
    asked = spark.createDataFrame([(1, "Bearer k", "/v1/complete")], "request_id long, auth_header string, path string")
    assert [r.tenant_id for r in access.authenticate(asked, tenants).collect()] == ["a"]


def test_rules_of_the_time(spark):
    """Each request by the version in force at its time, also for one written twice."""
    def at(hour):
        return dt.datetime(2024, 5, 1, hour, tzinfo=dt.UTC)

    def written(name, hour, op=">"):
        return ("t", name, 0, name, [(None, "input.risk_score", op, 0.0, [])], "TAG", name, at(hour))

    log = [written("a", 2), written("b", 4), written("bad", 6, "~"), written("a", 8), written("c", 8)]
    log += [("u", "x", 0, "x", [(None, "input.risk_score", ">", 0.0, [])], "LOG", "x", None)]
    requests = [(h, tenant, at(h), 0.5, "m", 0.0) for h in range(1, 12) for tenant in ("t", "u", None)]
    frame = spark.createDataFrame(requests, "request_id int, tenant_id string, ts timestamp, score double, model string, daily_tokens double")
    got = policy.evaluate_tenant_policies(frame, spark.createDataFrame(log, RULE_SCHEMA), as_of="ts").collect()
    assert len(got) == len(requests)
    found = {(r.tenant_id, r.request_id): r.rule_name for r in got}
    for hour in range(1, 12):
        want = None if hour < 2 else "a" if hour < 4 else "b" if hour < 8 else "c"
        assert found["t", hour] == want and found["u", hour] == "x" and found[None, hour] is None


@pytest.mark.parametrize("chunk_rows", [7, 1000])
def test_fold_by_the_rules_of_the_time(spark, chunk_rows):
    """Totals and verdicts request by request, with rules that change during a day."""
    draw = random.Random(chunk_rows)
    start = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
    bounds = {"a": (3, 40.0), "b": (9, 15.0), "c": (15, 70.0)}
    log = [
        (tenant, name, 0, name, [(None, "tenant.daily_tokens", ">", bound, [])], "BLOCK", name, start + dt.timedelta(hours=hour))
        for tenant in ("t", "u") for name, (hour, bound) in bounds.items()
    ]
    requests = [
        (i, draw.choice("tu"), start + dt.timedelta(seconds=draw.randrange(86_400)), 0.5, "m", draw.randrange(6)) for i in range(120)
    ]
    frame = spark.createDataFrame(requests, "request_id int, tenant_id string, ts timestamp, score double, model string, tokens long")
    got = {
        r.request_id: (r.used_before, r.quota_ok, r.charged, r.policy_rule)
        for r in quota.quota_policy_fold(
            frame, spark.createDataFrame(log, RULE_SCHEMA), 60, chunk_rows=chunk_rows, slot_seconds=600, as_of=True
        ).collect()
    }
    used = {}
    for i, tenant, ts, _, _, tokens in sorted(requests, key=lambda r: (r[2], r[0])):
        before = used.get(tenant, 0)
        hours = (ts - start).total_seconds() / 3600
        name = max((n for n, (h, _) in bounds.items() if h <= hours), default=None)
        if before >= 60:
            assert got[i] == (None, False, 0, None)
            continue
        blocked = name is not None and before > bounds[name][1]
        assert got[i] == (before, True, 0 if blocked else tokens, name if blocked else None), i
        used[tenant] = before + (0 if blocked else tokens)


@pytest.mark.parametrize("as_of", [True, False])
def test_requests_do_not_move_for_few_rules(spark, as_of):
    """The rules' size is known only once they are written; a join by tenant would be few tasks."""
    rows = [("click", dt.datetime(2024, 1, 2), i, 0.5, "m", 1) for i in range(20)]
    requests = spark.createDataFrame(
        rows, "tenant_id string, ts timestamp, request_id long, score double, model string, tokens long"
    )
    rules = W.policy_rules(spark)
    judged = quota.quota_policy_fold(requests, rules, 300, as_of=as_of)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == plan.count("rightHint=(strategy=broadcast)") > 0
    if as_of:
        placed = policy.with_rules_of_the_time(requests, rules)
        plan = placed._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftOuter") == plan.count("rightHint=(strategy=broadcast)") == 2

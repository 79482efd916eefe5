"""End-to-end replay: what the service would have answered to each request.

Texts are scanned where they are read; only narrow rows (ids, times, scores, flags,
token counts) go through the shuffles by tenant.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions import output as O
from ..functions import rules as R
from ..operators import access, admission, intercept, policy, quota, scan
from ..session import write_stage
from ..sources import wire


@dataclass(frozen=True)
class Limits:
    max_body_bytes: int = V.MAX_BODY_BYTES
    requests_per_window: int = V.REQUESTS_PER_MINUTE
    window_seconds: float = 60.0
    daily_tokens: int = V.DAILY_TOKENS
    window_bytes: int = V.WINDOW_BYTES
    chunk_rows: int = admission.CHUNK_ROWS
    force_model: str | None = None  # judge all requests as if they asked for this model


_NARROW = ["request_id", "ts", "path", "model", "provider_error"]


def _scanned(requests: DataFrame, tenants: DataFrame, limits: Limits) -> DataFrame:
    """Stateless stage: tenant, gate, prompt score, output flag and token cost."""
    known = access.authenticate(requests, tenants)
    texts = ["response_text", "input_tokens", "output_tokens"]
    carried = [*_NARROW, "tenant_id", "auth_status", *texts]
    gated = wire.gate_requests(known, limits.max_body_bytes, carried)
    carried += ["gate_status", "gate_error", "prompt"]
    scored = scan.input_scan(gated, "prompt", carried)
    asked = F.col("prompt").isNotNull()
    blocked = F.col("verdict") == "block"
    reaches_model = asked & ~blocked & F.col("provider_error").isNull()
    complete = F.col("path") == "/v1/complete"
    cost = quota.charge(
        F.col("prompt"), F.col("response_text"), F.col("input_tokens"), F.col("output_tokens")
    )
    return scored.select(
        *_NARROW,
        "tenant_id",
        "auth_status",
        "gate_status",
        "gate_error",
        F.when(asked, F.col("score")).alias("score"),
        F.when(asked, F.col("verdict")).alias("verdict"),
        F.when(reaches_model & complete, O.contains_unsafe(F.col("response_text")))
        .otherwise(F.lit(False)).alias("unsafe_output"),
        F.when(reaches_model & complete, cost).otherwise(F.lit(0).cast("long")).alias("tokens"),
    )


def reads_tokens(rules: DataFrame) -> bool:
    """True if any rule reads the tenant's tokens of the day."""
    reading = F.exists("atoms", lambda a: a["field"] == "tenant.daily_tokens")
    return not rules.filter(reading).isEmpty()


def decide(
    requests: DataFrame, tenants: DataFrame, rules: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """Status and error of each request, with the columns of every stage.

    A request is judged by the version of its tenant's rules in force at its time.  The
    first failing stage answers: key, rate, quota, method and body, prompt,
    policy, model, output.  Requests refused later still hold their rate slot;
    refused ones charge no tokens, nor do streams.
    """
    # The scan of the texts runs once; everything after it starts from narrow rows.
    scanned = write_stage(_scanned(requests, tenants, limits), "scanned")
    limited = F.col("tenant_id").isNotNull() & ~F.col("path").isin(*V.OPEN_ROUTES)
    admitted = admission.admit(
        scanned.filter(limited), limits.requests_per_window, limits.window_seconds,
        chunk_rows=limits.chunk_rows,
    ).withColumn("tokens", F.when(F.col("admitted"), F.col("tokens")).otherwise(F.lit(0).cast("long")))
    admitted = write_stage(admitted, "admitted")

    if reads_tokens(rules):
        judged = quota.quota_policy_fold(
            admitted, rules, limits.daily_tokens, chunk_rows=limits.chunk_rows,
            force_model=limits.force_model, as_of=True,
        )
    else:
        ruled = policy.evaluate_tenant_policies(
            admitted.withColumn("daily_tokens", F.lit(0.0)), rules, force_model=limits.force_model, as_of="ts"
        ).drop("daily_tokens")
        blocks = F.coalesce(F.col("action") == "BLOCK", F.lit(False))
        judged = quota.daily_quota(
            ruled.withColumn(
                "tokens", F.when(blocks, F.lit(0).cast("long")).otherwise(F.col("tokens"))
            ),
            limits.daily_tokens,
        ).select(
            *admitted.columns,
            "used_before",
            "quota_ok",
            F.when(F.col("quota_ok"), F.col("tokens")).otherwise(F.lit(0).cast("long")).alias("charged"),
            F.col("rule_name").alias("policy_rule"),
            F.col("action").alias("policy_action"),
            F.col("reason").alias("policy_reason"),
        )
    rest = scanned.filter(~limited)
    everything = judged.unionByName(rest, allowMissingColumns=True)
    return _answers(everything)


def _answers(df: DataFrame) -> DataFrame:
    stream = F.col("path") == "/v1/stream"
    open_route = F.col("path").isin(*V.OPEN_ROUTES)
    error = (
        F.when(open_route, None)
        .when(F.col("auth_status") == 401, "unauthorized")
        .when(~F.col("admitted"), "rate_limit_exceeded")
        .when(~F.col("quota_ok"), "daily_quota_exceeded")
        .when(F.col("gate_status").isNotNull(), F.col("gate_error"))
        .when(F.col("verdict") == "block", "guardrail_block")
        .when(F.col("policy_action") == "BLOCK", "policy_block")
        .when(F.col("provider_error") == "timeout", "provider_timeout")
        .when(F.col("provider_error").isNotNull(), "provider_error")
        .when(F.col("unsafe_output"), "output_policy_violation")
    )
    # A stream has answered 200 before its model or output can fail.
    status = (
        F.when(F.col("error").isNull(), 200)
        .when(F.col("error") == "unauthorized", 401)
        .when(F.col("error").isin("rate_limit_exceeded", "daily_quota_exceeded"), 429)
        .when(F.col("gate_status").isNotNull(), F.col("gate_status"))
        .when(F.col("error").isin("guardrail_block", "policy_block"), 403)
        .when(stream, 200)
        .when(F.col("error") == "provider_timeout", 504)
        .when(F.col("error") == "provider_error", 502)
        .otherwise(403)
    )
    reached_policy = (
        F.coalesce(F.col("admitted"), F.lit(False))
        & F.coalesce(F.col("quota_ok"), F.lit(False))
        & F.coalesce(F.col("verdict") != "block", F.lit(False))
    )
    answered = df.withColumn("error", error).withColumn("status", status)
    shown = {
        "policy_rule": F.col("policy_rule"),
        "policy_action": F.col("policy_action"),
        "policy_reason": F.col("policy_reason"),
    }
    return answered.select(
        "request_id", "ts", "tenant_id", "path", "model", "score", "verdict",
        "admitted", "remaining", "quota_ok", "used_before",
        F.coalesce("charged", F.lit(0).cast("long")).alias("charged"),
        reached_policy.alias("policy_evaluated"),
        *[F.when(reached_policy, column).alias(name) for name, column in shown.items()],
        "status", "error",
        F.when(F.col("error") == "guardrail_block", "Request blocked by input safety policy")
        .when(F.col("error") == "policy_block", F.col("policy_reason")).alias("reason"),
    )


def decide_complete(
    requests: DataFrame, tenants: DataFrame, rules: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """Decisions for every request but streams; streams still use up rate slots."""
    return decide(requests, tenants, rules, limits).filter(F.col("path") != "/v1/stream")


def decide_stream(
    requests: DataFrame, tenants: DataFrame, rules: DataFrame, chunks: DataFrame,
    limits: Limits = Limits(),
) -> DataFrame:
    """Decisions for streams, with the outcome of each stream that was opened.

    `chunks` holds the model's chunks with stream_id equal to request_id.
    """
    decided = decide(requests, tenants, rules, limits).filter(F.col("path") == "/v1/stream")
    return _with_outcomes(decided, chunks, limits)


def decide_all(
    requests: DataFrame, tenants: DataFrame, rules: DataFrame, chunks: DataFrame,
    limits: Limits = Limits(),
) -> DataFrame:
    """Decisions for every request; stream columns are null for all but streams.

    `first_sent` tells whether anything was forwarded before the end of a stream.
    """
    decided = write_stage(decide(requests, tenants, rules, limits), "decided")
    is_stream = F.coalesce(F.col("path") == "/v1/stream", F.lit(False))
    streams = _with_outcomes(decided.filter(is_stream), chunks, limits)
    # A stream that ends well sends its last window by the drain only.
    held = F.when(F.col("aborted"), F.lit(0)).otherwise(F.lit(limits.window_bytes))
    streams = streams.withColumn("first_sent", F.coalesce(F.col("forwarded_bytes") > held, F.lit(False)))
    return streams.unionByName(decided.filter(~is_stream), allowMissingColumns=True)


def _with_outcomes(decided: DataFrame, chunks: DataFrame, limits: Limits) -> DataFrame:
    outcomes = intercept.stream_abort(chunks, limits.window_bytes).withColumnRenamed(
        "stream_id", "request_id"
    )
    # One row per stream is never small enough to be copied to every task, whatever its files take.
    joined = decided.join(outcomes.hint("merge"), "request_id", "left")
    opened = F.col("error").isNull() | F.col("error").isin("provider_timeout", "provider_error")
    clean = F.col("error").isNull()
    aborted = clean & F.coalesce(F.col("aborted"), F.lit(False))
    return joined.select(
        *[c for c in decided.columns if c not in ("error",)],
        F.when(aborted, "output_policy_violation").otherwise(F.col("error")).alias("error"),
        opened.alias("opened"),
        aborted.alias("aborted"),
        F.when(aborted, F.col("abort_stage")).alias("abort_stage"),
        F.when(clean, F.coalesce("forwarded_bytes", F.lit(0).cast("long"))).alias("forwarded_bytes"),
    )

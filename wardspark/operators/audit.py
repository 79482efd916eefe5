"""Audit events of decided requests."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

LEVELS = {"info": 0, "warn": 1, "error": 2}
# Answers given before the request reached a handler.
_EARLY = ("unauthorized", "rate_limit_exceeded", "daily_quota_exceeded")


def _events() -> list[tuple[str, str, Column]]:
    """(level, message, condition) in the order a request passes them."""
    error, status = F.coalesce("error", F.lit("")), F.col("status")
    handled = ~error.isin(*_EARLY)
    complete = F.col("path") == "/v1/complete"
    scanned = F.col("verdict").isNotNull() & handled
    answered = complete & (error.isin("", "output_policy_violation"))
    stream = F.col("path") == "/v1/stream"
    unsafe = stream & (error == "output_policy_violation")
    return [
        ("warn", "auth_failed", error == "unauthorized"),
        ("warn", "rate_limited", error == "rate_limit_exceeded"),
        ("warn", "quota_exceeded", error == "daily_quota_exceeded"),
        ("info", "request_started", handled),
        ("warn", "request_body_too_large", complete & (error == "payload_too_large")),
        ("info", "guardrail_scan", scanned),
        ("warn", "guardrail_blocked", error == "guardrail_block"),
        ("warn", "policy_blocked", error == "policy_block"),
        ("error", "provider_timeout", complete & (error == "provider_timeout")),
        ("error", "provider_error", complete & (error == "provider_error")),
        ("info", "provider_response_ok", answered),
        ("warn", "output_blocked", complete & (error == "output_policy_violation")),
        ("error", "stream_provider_timeout", stream & (error == "provider_timeout")),
        ("error", "stream_provider_error", stream & (error == "provider_error")),
        ("info", "stream_first_chunk_sent", stream & F.col("first_sent")),
        ("warn", "stream_aborted_unsafe_output", unsafe & (F.col("abort_stage") == "flush")),
        ("warn", "stream_aborted_unsafe_output_drain", unsafe & (F.col("abort_stage") == "drain")),
        ("info", "stream_completed", stream & (error == "")),
        ("info", "request_completed", handled & status.isNotNull()),
    ]


def audit_events(decisions: DataFrame, min_level: str = "info") -> DataFrame:
    """One row per log event at or above `min_level` (unknown levels read as info).

    `decisions` are those of `decide_all`: completions and streams.
    """
    floor = LEVELS.get(min_level, 0)
    entries = [
        F.when(condition, F.struct(
            F.lit(seq).alias("seq"), F.lit(level).alias("level"), F.lit(message).alias("message")
        ))
        for seq, (level, message, condition) in enumerate(_events())
        if LEVELS[level] >= floor
    ]
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    exploded = decisions.withColumn("_event", F.explode(kept))
    message = F.col("_event.message")
    scan = message.isin("guardrail_scan", "guardrail_blocked")
    policy = message == "policy_blocked"
    fields = F.struct(
        "request_id",
        "tenant_id",
        F.when(message.isin("request_started", "request_completed"), F.col("path")).alias("path"),
        F.when(message == "request_completed", F.col("status")).alias("status"),
        F.when(scan, F.col("score")).alias("score"),
        F.when(message == "guardrail_scan", F.col("verdict")).alias("verdict"),
        F.when(policy, F.col("policy_rule")).alias("rule"),
        F.when(policy, F.col("policy_reason")).alias("reason"),
    )
    return exploded.select(
        F.col("ts").alias("timestamp"),
        F.col("_event.seq").alias("seq"),
        F.col("_event.level").alias("level"),
        message.alias("message"),
        fields.alias("fields"),
    )


def write_audit_log(events: DataFrame, path: str) -> None:
    """Append the events as JSON lines, one folder per UTC day."""
    (
        events.withColumn("day", F.to_date("timestamp"))
        .drop("seq")
        .write.mode("append").partitionBy("day").json(path)
    )


def stream_audit_log(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that adds the events of a stream to the log as JSON lines, each once.

    A batch writes `path/batch=N/day=D`, over what an earlier try of it has left, so a
    batch that runs again after a failure leaves one set of lines.  `spark.read.json(path)`
    reads all, with the two folder names as columns.
    """

    def add(batch: DataFrame, number: int) -> None:
        (
            batch.withColumn("day", F.to_date("timestamp"))
            .drop("seq")
            .write.mode("overwrite").partitionBy("day").json(f"{path}/batch={number}")
        )

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)

from pyspark.sql import functions as F

from wardspark.operators import audit

SCHEMA = (
    "request_id long, ts timestamp, tenant_id string, path string, status int, error string, score double, "
    "verdict string, policy_rule string, policy_reason string, first_sent boolean, abort_stage string"
)


def decisions(spark):
    def row(rid, path, error=None, verdict="pass", first=None, stage=None):
        return (rid, None, "t", path, 200, error, 0.1, verdict, None, None, first, stage)

    return spark.createDataFrame([
        row(1, "/v1/complete"), row(2, "/v1/stream", first=True), row(3, "/v1/stream", "provider_timeout", first=False),
        row(4, "/v1/stream", "output_policy_violation", first=True, stage="flush"),
        row(5, "/v1/stream", "output_policy_violation", first=False, stage="drain"),
        row(6, "/v1/stream", "rate_limit_exceeded", None),
    ], SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))


def test_streams_have_their_events(spark):
    events = audit.audit_events(decisions(spark)).collect()
    by_request = {}
    for e in sorted(events, key=lambda e: e.seq):
        by_request.setdefault(e.fields.request_id, []).append(e.message)
    shared = ["request_started", "guardrail_scan"]
    assert by_request == {
        1: [*shared, "provider_response_ok", "request_completed"],
        2: [*shared, "stream_first_chunk_sent", "stream_completed", "request_completed"],
        3: [*shared, "stream_provider_timeout", "request_completed"],
        4: [*shared, "stream_first_chunk_sent", "stream_aborted_unsafe_output", "request_completed"],
        5: [*shared, "stream_aborted_unsafe_output_drain", "request_completed"],
        6: ["rate_limited"],
    }


def test_level_filter_and_sink(spark, tmp_path):
    events = audit.audit_events(decisions(spark), "warn")
    audit.write_audit_log(events, str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log")).collect()
    assert {r.message for r in back} == {
        "stream_provider_timeout", "stream_aborted_unsafe_output", "stream_aborted_unsafe_output_drain", "rate_limited"
    }


def test_a_stream_appends_each_event_once(spark, tmp_path, monkeypatch):
    folder, log = f"{tmp_path}/d", f"{tmp_path}/log"
    add = []
    for part in (decisions(spark).filter("request_id < 3"), decisions(spark).filter("request_id >= 3")):
        part.coalesce(1).write.mode("append").parquet(folder)
        events = audit.audit_events(spark.readStream.schema(part.schema).parquet(folder), "info")
        audit.stream_audit_log(events, log, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    want = sorted((e.fields.request_id, e.message) for e in audit.audit_events(decisions(spark)).collect())

    def read():
        return sorted((r.fields.request_id, r.message) for r in spark.read.json(log).collect())

    assert read() == want
    # A failure after the write and before the checkpoint runs the batch again.
    monkeypatch.setattr("pyspark.sql.streaming.DataStreamWriter.foreachBatch", lambda self, f: add.append(f) or self)
    audit.stream_audit_log(events, log, f"{tmp_path}/checkpoint")
    add[0](audit.audit_events(decisions(spark).filter("request_id >= 3")), 1)
    assert read() == want

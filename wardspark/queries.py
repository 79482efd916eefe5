"""Registered queries: one per operator, over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import workload as W
from .functions import fixed_values as V
from .functions import text as T
from .operators import access, admission, audit, intercept, metrics, policy, quota, scan
from .plans import corpus
from .plans.decide import Limits, decide, decide_all, decide_complete, decide_stream
from .session import stage_folder, write_stage
from .sources import tables, wire
from .streaming import live

LIMITS = Limits(
    max_body_bytes=120, requests_per_window=3, window_seconds=3600.0, daily_tokens=1500,
    window_bytes=64,
)
RATE_LIMIT, RATE_WINDOW = 3, 3600.0
QUOTA = 2500
HOLD = 64
SIGNALS = list(scan.SIGNAL_NAMES)
FLAGS = list(V.OUTPUT_PATTERNS)


def _text_query(function: Callable) -> Callable:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return W.documents(spark, folder).select("doc_id", function(F.col("text")).alias("result"))

    return run


def prompt_variants(spark, folder):
    forms = W.documents(spark, folder).select(
        "doc_id", T.prompt_variants(F.col("text")).alias("forms")
    )
    return forms.select("doc_id", *[F.col("forms")[i].alias(f"form_{i}") for i in range(6)])


def _signal_query(name: str) -> Callable:
    def run(spark, folder):
        signals = scan.with_signals(W.documents(spark, folder), "text", ["doc_id"])
        return signals.select("doc_id", F.round(name, 6).alias(name))

    return run


def input_scan(spark, folder):
    scanned = scan.input_scan(W.prompts(spark, folder), "prompt", ["prompt_id", "tenant_id"])
    return scanned.drop("signals")


def verdict_summary(spark, folder):
    scanned = scan.input_scan(W.documents(spark, folder), "text", ["lang", "source"])
    return scan.verdict_summary(scanned, ["lang", "source"])


def request_gate(spark, folder):
    return wire.gate_requests(W.requests(spark, folder), LIMITS.max_body_bytes, ["request_id", "path"])


def sse_frames(spark, folder):
    return wire.parse_sse_frames(W.raw_streams(spark, folder))


def sse_deltas(spark, folder):
    return wire.extract_deltas(W.json_streams(spark, folder))


def completions(spark, folder):
    return wire.parse_completions(W.raw_completions(spark, folder), "raw", ["request_id"])


def authenticate(spark, folder):
    known = access.authenticate(W.requests(spark, folder), W.tenants(spark, folder))
    return known.select("request_id", "tenant_id", "tenant_name", "auth_status")


def unauthorized(spark, folder):
    refused = access.unauthorized(W.requests(spark, folder), W.tenants(spark, folder))
    return refused.select("request_id", "path", "auth_header")


def policy_first_match(spark, folder):
    judged = policy.evaluate_policy(W.rule_contexts(spark, folder), W.TENANT_RULES["click"])
    return judged.select("request_id", "matched", "rule_name", "action", "reason")


def policy_rule_join(spark, folder):
    judged = policy.evaluate_tenant_policies(W.rule_contexts(spark, folder), W.policy_rules(spark))
    return judged.select("request_id", "tenant_id", "matched", "rule_name", "action", "reason")


def policy_as_of(spark, folder):
    """Each request judged by the version in force when it came."""
    judged = policy.evaluate_tenant_policies(
        W.rule_contexts(spark, folder), W.policy_rules(spark, W.RULE_LOG), as_of="ts"
    )
    return judged.select("request_id", "tenant_id", "matched", "rule_name", "action", "reason")


def rule_table_check(spark, folder):
    return policy.rule_table_check(W.rule_rows(spark, folder))


def live_versions(spark, folder):
    return policy.live_versions(W.rule_rows(spark, folder))


def rule_hits(spark, folder):
    return policy.rule_hits(W.rule_contexts(spark, folder), W.policy_rules(spark))


def policy_versions(spark, folder):
    return policy.register_policy_versions(W.policy_sources(spark, folder))


def output_scan(spark, folder):
    return scan.output_scan(W.documents(spark, folder), "text", ["doc_id"])


def page_scan(spark, folder):
    return scan.output_scan(W._texts(spark, folder, "pages"), "html", ["page_id"])


def output_scan_views(spark, folder):
    framed = W.answers(spark, folder).withColumn(
        "raw", F.concat(F.lit("data: "), F.replace("answer", F.lit(" "), F.lit("\n\ndata: ")))
    )
    return scan.output_scan_views(framed, "raw", ["stream_id"])


def sync_output_block(spark, folder):
    answers = W.answers(spark, folder)
    flagged = scan.output_scan(answers, "answer", ["stream_id", "tenant_id"])
    return flagged.filter("unsafe").select(
        "stream_id", "tenant_id", F.lit(403).alias("status"),
        F.lit("output_policy_violation").alias("error"),
    )


def pii_counts(spark, folder):
    flagged = scan.output_scan(W.documents(spark, folder), "text", ["lang", "source"])
    return scan.pattern_counts(flagged, ["lang", "source"])


def rate_limit(spark, folder):
    rows = W.rule_contexts(spark, folder).select("tenant_id", "request_id", "ts")
    return admission.admit(rows, RATE_LIMIT, RATE_WINDOW).drop("ts")


def daily_quota(spark, folder):
    rows = W.rule_contexts(spark, folder).select("tenant_id", "request_id", "ts", "tokens")
    return quota.daily_quota(rows, QUOTA).drop("ts")


def quota_policy_fold(spark, folder):
    rows = W.rule_contexts(spark, folder).drop("daily_tokens")
    folded = quota.quota_policy_fold(rows, W.policy_rules(spark, W.RULE_LOG), LIMITS.daily_tokens, as_of=True)
    return folded.select(
        "tenant_id", "request_id", "used_before", "quota_ok", "charged", "policy_rule", "policy_action"
    )


def token_usage(spark, folder):
    asked = W.requests(spark, folder).withColumn("tenant_id", F.col("model")).withColumn(
        "prompt", F.col("body")
    )
    return quota.daily_usage(quota.token_usage(asked))


def holdback_buffer(spark, folder):
    return intercept.holdback_buffer(W.chunks(spark, folder), HOLD, run_chunks=64)


def stream_abort(spark, folder):
    return intercept.stream_abort(W.chunks(spark, folder), HOLD)


def stream_timing(spark, folder):
    timing = intercept.stream_timing(W.chunks(spark, folder), HOLD)
    return timing.withColumn("avg_gap_us", F.round("avg_gap_us", 3))


def inter_chunk_histogram(spark, folder):
    gaps = intercept.forward_gaps(W.chunks(spark, folder), HOLD).withColumn(
        "kind", F.pmod("stream_id", F.lit(5))
    ).withColumn("seconds", F.col("gap_us") / 1e6)
    histogram = metrics.latency_histogram(gaps, "seconds", ["kind"], V.INTER_CHUNK_BUCKETS)
    return _finite(histogram)


def ttft_histogram(spark, folder):
    timing = intercept.stream_timing(W.chunks(spark, folder), HOLD).withColumn(
        "kind", F.pmod("stream_id", F.lit(5))
    )
    return _finite(metrics.ttft_histogram(timing, ["kind"]))


def check_histogram(spark, folder):
    checks = W.latencies(spark, folder).withColumn("check_seconds", F.col("seconds") / 1000)
    return _finite(metrics.check_histogram(checks, "check_seconds", ["tenant_id"]), 6)


def _finite(histogram: DataFrame, digits: int = 3) -> DataFrame:
    """The bound as text, so that infinity compares as a plain value."""
    return histogram.withColumn(
        "le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(
            F.format_number(F.col("le"), digits))
    ).withColumn("sum", F.round("sum", 4))


def requests_total(spark, folder):
    return metrics.requests_total(W.latencies(spark, folder))


def _decisions(spark, folder):
    return decide(
        W.requests(spark, folder), W.tenants(spark, folder), W.policy_rules(spark, W.RULE_LOG), LIMITS
    )


def _all_decisions(spark, folder):
    return decide_all(
        W.requests(spark, folder), W.tenants(spark, folder), W.policy_rules(spark, W.RULE_LOG),
        W.request_chunks(spark, folder), LIMITS,
    )


def blocks_total(spark, folder):
    return metrics.blocks_total(_all_decisions(spark, folder))


def policy_verdicts(spark, folder):
    return metrics.policy_verdicts(_decisions(spark, folder))


def rate_hits(spark, folder):
    return metrics.rate_hits(_decisions(spark, folder))


def stream_aborts(spark, folder):
    chunks = W.chunks(spark, folder)
    owners = W.answers(spark, folder).select("stream_id", "tenant_id")
    return metrics.stream_aborts(intercept.stream_abort(chunks, HOLD).join(owners, "stream_id"))


def latency_histogram(spark, folder):
    return _finite(metrics.latency_histogram(W.latencies(spark, folder), "seconds", ["tenant_id", "path"]))


def histogram_quantile(spark, folder):
    histogram = metrics.latency_histogram(W.latencies(spark, folder), "seconds", ["tenant_id"])
    values = metrics.histogram_quantile(histogram, ["tenant_id"], (0.5, 0.95, 0.99))
    return values.withColumn("value", F.round("value", 6))


def rate_per_second(spark, folder):
    rates = metrics.rate_per_second(W.latencies(spark, folder), ["tenant_id"])
    return rates.withColumn("per_second", F.round("per_second", 6))


def error_rate(spark, folder):
    rates = metrics.error_rate(W.latencies(spark, folder), ["tenant_id", "status"])
    return rates.withColumn("per_second", F.round("per_second", 6))


def load_report(spark, folder):
    return metrics.load_report(W.latencies(spark, folder)).withColumn(
        "throughput", F.round("throughput", 6)
    )


def approximate_ranks(spark, folder):
    """Percentiles per tenant, from sketches kept per tenant and day."""
    daily = W.latencies(spark, folder).withColumn("day", F.to_date("ts"))
    sketches = metrics.latency_sketches(daily, "seconds", ["tenant_id", "day"])
    ranks = metrics.approximate_ranks(sketches, ["tenant_id"], (0.5, 0.95, 0.99))
    return ranks.withColumn("value", F.round("value", 6))


def total_requests(spark, folder):
    return metrics.total_requests(W.latencies(spark, folder))


def decide_complete_query(spark, folder):
    return decide_complete(
        W.requests(spark, folder), W.tenants(spark, folder), W.policy_rules(spark, W.RULE_LOG), LIMITS
    ).drop("ts", "model")


def decide_stream_query(spark, folder):
    decided = decide_stream(
        W.requests(spark, folder), W.tenants(spark, folder), W.policy_rules(spark, W.RULE_LOG),
        W.request_chunks(spark, folder), LIMITS,
    )
    return decided.select(
        "request_id", "tenant_id", "status", "error", "opened", "aborted", "abort_stage",
        "forwarded_bytes",
    )


def _audit_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("fields.request_id").alias("request_id"), "level", "message",
        F.col("fields.tenant_id").alias("tenant_id"), F.col("fields.status").alias("status"),
        F.col("fields.score").alias("score"), F.col("fields.rule").alias("rule"),
    )


def audit_log(spark, folder):
    return _audit_columns(audit.audit_events(_all_decisions(spark, folder), "info"))


def live_audit_log(spark, folder):
    """Decisions as a stream into the log of JSON lines, read back."""
    base = stage_folder(spark, "audit")
    _all_decisions(spark, folder).write.parquet(f"{base}/decisions.parquet")
    events = audit.audit_events(tables.stream_table(spark, base, "decisions"), "info")
    audit.stream_audit_log(events, f"{base}/log", f"{base}/checkpoint").trigger(
        availableNow=True
    ).start().awaitTermination()
    return _audit_columns(spark.read.schema(events.drop("seq").schema).json(f"{base}/log"))


def json_corpus(spark, folder):
    """Documents as JSON lines, read with their schema: what a scan of JSON inputs starts from."""
    path = f"{stage_folder(spark, 'json')}/documents"
    documents = W.documents(spark, folder).select("doc_id", "lang", "source", "text")
    documents.write.json(path, ignoreNullFields=False)
    rows, _ = tables.read_json(spark, path, "doc_id bigint, lang string, source string, text string")
    return rows.select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


def corpus_scan(spark, folder):
    return corpus.corpus_report(W.documents(spark, folder), "text", ["lang", "source"])


FILES_PER_TRIGGER = 8
DELAY = "1 hour"
ARRIVALS = 4


def _in_time(spark, folder, table: str, columns: dict[str, str], name: str, delay: str = DELAY) -> DataFrame:
    """Rows of a table as a closed stream, without the late ones."""
    source = tables.stream_table(spark, folder, table, FILES_PER_TRIGGER)
    kept, _ = tables.split_late(
        W._select(source, columns), name, delay, files_per_trigger=FILES_PER_TRIGGER
    )
    return kept


def late_rows(spark, folder):
    """Per tenant: all rows, and those not too late, of events that arrive in disorder."""
    base = stage_folder(spark, "arrivals")
    events = W.rule_contexts(spark, folder)
    for arrival in range(ARRIVALS):  # the input goes on; the query is started again for what is new
        events.filter(F.col("request_id") % ARRIVALS == arrival).write.mode("append").parquet(f"{base}/events")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/events")
        router = tables.route_late(source, f"{base}/routed", DELAY)
        router.trigger(availableNow=True).start().awaitTermination()
    in_time, late = tables.routed(spark, f"{base}/routed", events.schema)
    both = in_time.select("tenant_id", F.lit(0).alias("late")).union(late.select("tenant_id", F.lit(1)))
    return both.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.lit(1) - F.col("late")).alias("in_time")
    )


def live_rate_limit(spark, folder):
    events = _in_time(spark, folder, "events", W.context_columns(False), "live-rate")
    limited = live.live_rate_limit(events, RATE_LIMIT, RATE_WINDOW, DELAY)
    return tables.run_available(limited, "live-rate").drop("us")


def live_daily_quota(spark, folder):
    events = _in_time(spark, folder, "events", W.context_columns(False), "live-quota")
    checked = live.live_daily_quota(events, QUOTA, DELAY)
    return tables.run_available(checked, "live-quota").drop("us")


def live_intercept(spark, folder):
    """Half of the streams send no end mark and are drained once they are idle."""
    answered = W._select(tables.stream_table(spark, folder, "conversations", FILES_PER_TRIGGER), W.answer_columns(False))
    ended = F.when(F.col("stream_id") % 2 == 0, F.array(F.lit("[DONE]"))).otherwise(F.array().cast("array<string>"))
    words = F.concat(F.split("answer", " ", -1), ended)
    framed = answered.select(
        "stream_id", F.posexplode(words).alias("chunk_idx", "word")
    ).select(
        "stream_id", F.col("chunk_idx").cast("long").alias("chunk_idx"),
        F.timestamp_micros(F.lit(W.BASE_US) + F.col("stream_id") * 1000 + F.col("chunk_idx") * 20_000).alias("ts"),
        F.concat(F.lit("data: "), F.col("word"), F.lit("\n\n")).alias("raw"),
    )
    chunks, _ = tables.split_late(framed, "live-chunks", "30 seconds", files_per_trigger=FILES_PER_TRIGGER)
    sent = tables.run_available(live.live_intercept(chunks, HOLD, watermark="30 seconds"), "live-intercept")
    return sent.groupBy("stream_id").agg(
        F.sum(F.octet_length("payload").cast("long")).alias("forwarded_bytes"),
        F.max(F.when(F.col("event").isin("abort", "drain_abort"), F.col("event"))).alias("stopped"),
    )


def live_input_scan(spark, folder):
    conversations = tables.stream_table(spark, folder, "conversations")
    prompts = W._select(conversations, W.prompt_columns(False))
    return tables.run_available(
        live.live_input_scan(prompts, "prompt", ["prompt_id", "tenant_id"]), "live-scan"
    )


def live_policy(spark, folder):
    """Each micro-batch judged by the rules in force when it starts, one folder per batch."""
    events = tables.stream_table(spark, folder, "events", FILES_PER_TRIGGER)
    base = stage_folder(spark, "live-policy")
    rules = write_stage(W.policy_rules(spark), "rules")
    decided = _judged(spark, W._select(events, W.context_columns(False)), lambda: rules, base)
    return decided.select("request_id", "tenant_id", "matched", "rule_name", "action", "reason")


def _judged(spark, scored, load_rules, base):
    def write(decided, batch_id):
        decided.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = live.live_decisions(scored, load_rules, write, f"{base}/rules")
    query.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def live_policy_refresh(spark, folder):
    """Events that arrive a month's part at a time, and rules that change in between.

    Before each arrival the log of rules gains what was written before the arrival begins.
    """
    base = stage_folder(spark, "live-refresh")
    events = W.rule_contexts(spark, folder)
    log = write_stage(W.policy_rules(spark, W.RULE_LOG), "rules")
    starts = [*W.ARRIVAL_STARTS, None]
    for begin, end in zip(starts, starts[1:]):
        inside = F.lit(True) if end is None else F.col("ts") < F.lit(end)
        if begin is not W.ARRIVAL_STARTS[0]:
            inside = inside & (F.col("ts") >= F.lit(begin))
        events.filter(inside).write.mode("append").parquet(f"{base}/events")
        arriving = spark.readStream.schema(events.schema).parquet(f"{base}/events")
        decided = _judged(spark, arriving, lambda: log.filter(F.col("written_at") <= F.lit(begin)), base)
    return decided.select("request_id", "tenant_id", "matched", "rule_name", "action", "reason")


def live_counters(spark, folder):
    events = _in_time(spark, folder, "events", W.latency_columns(False), "live-counters")
    counts = live.live_counters(events, ["tenant_id", "status"], window="1 day", watermark=DELAY)
    return tables.run_available(counts, "live-counters")


def live_histogram(spark, folder):
    events = _in_time(spark, folder, "events", W.latency_columns(False), "live-histogram")
    histogram = live.live_histogram(events, "seconds", ["tenant_id"], window="1 day", watermark=DELAY)
    rows = tables.run_available(histogram, "live-histogram")
    return _finite(rows.withColumn("window", F.col("window.start"))).withColumnRenamed(
        "window", "window_start"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "request_gate": request_gate,
    "sse_frames": sse_frames,
    "sse_deltas": sse_deltas,
    "completions": completions,
    "audit_log": audit_log,
    "live_audit_log": live_audit_log,
    "json_corpus": json_corpus,
    "policy_versions": policy_versions,
    "strip_invisible": _text_query(T.strip_invisible),
    "fold_leet": _text_query(T.fold_leet),
    "collapse_spaced": _text_query(T.collapse_spaced),
    "strip_ws": _text_query(T.strip_whitespace),
    "prompt_variants": prompt_variants,
    **{f"signal_{name}": _signal_query(name) for name in SIGNALS},
    "input_scan": input_scan,
    "verdict_summary": verdict_summary,
    "authenticate": authenticate,
    "unauthorized": unauthorized,
    "policy_first_match": policy_first_match,
    "policy_rule_join": policy_rule_join,
    "policy_as_of": policy_as_of,
    "rule_table_check": rule_table_check,
    "live_versions": live_versions,
    "rule_hits": rule_hits,
    "output_scan": output_scan,
    "page_scan": page_scan,
    "output_scan_views": output_scan_views,
    "sync_output_block": sync_output_block,
    "pii_counts": pii_counts,
    "rate_limit": rate_limit,
    "daily_quota": daily_quota,
    "quota_policy_fold": quota_policy_fold,
    "token_usage": token_usage,
    "holdback_buffer": holdback_buffer,
    "stream_abort": stream_abort,
    "stream_timing": stream_timing,
    "inter_chunk_histogram": inter_chunk_histogram,
    "ttft_histogram": ttft_histogram,
    "check_histogram": check_histogram,
    "requests_total": requests_total,
    "blocks_total": blocks_total,
    "policy_verdicts": policy_verdicts,
    "rate_hits": rate_hits,
    "stream_aborts": stream_aborts,
    "latency_histogram": latency_histogram,
    "histogram_quantile": histogram_quantile,
    "rate_per_second": rate_per_second,
    "error_rate": error_rate,
    "load_report": load_report,
    "approximate_ranks": approximate_ranks,
    "total_requests": total_requests,
    "decide_complete": decide_complete_query,
    "decide_stream": decide_stream_query,
    "corpus_scan": corpus_scan,
    "late_rows": late_rows,
    "live_rate_limit": live_rate_limit,
    "live_daily_quota": live_daily_quota,
    "live_intercept": live_intercept,
    "live_input_scan": live_input_scan,
    "live_policy": live_policy,
    "live_policy_refresh": live_policy_refresh,
    "live_counters": live_counters,
    "live_histogram": live_histogram,
}

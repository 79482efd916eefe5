"""Counters, latency histograms, quantiles and rates."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.slots import micros, slot

REFUSED_EARLY = (401, 429)
FINE_SLOTS = 4096
SKETCH_ERROR = 0.01


def requests_total(
    decisions: DataFrame, by: tuple[str, ...] = ("tenant_id", "status", "path"),
    include_refused: bool = False,
) -> DataFrame:
    """Requests by tenant, status and path; early refusals and open routes apart."""
    counted = decisions.filter(~F.col("path").isin(*V.OPEN_ROUTES))
    if not include_refused:
        counted = counted.filter(~F.col("status").isin(*REFUSED_EARLY))
    return counted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, *by: str) -> DataFrame:
    """Rows per label set, labels all present."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def blocks_total(decisions: DataFrame) -> DataFrame:
    """Blocks by tenant and stage: input, output (streamed), output_sync.

    `decisions` are those of `decide_all`, which knows how streams ended.
    """
    stage = (
        F.when(F.col("error") == "guardrail_block", "input")
        .when(F.col("error") == "output_policy_violation",
              F.when(F.col("path") == "/v1/stream", "output").otherwise("output_sync"))
    )
    return count_by(decisions.withColumn("stage", stage), "tenant_id", "stage")


def policy_verdicts(decisions: DataFrame) -> DataFrame:
    """Policy outcomes by tenant: block, tag, log, redact, or pass if no rule held."""
    evaluated = decisions.filter("policy_evaluated").withColumn(
        "verdict", F.coalesce(F.lower("policy_action"), F.lit("pass"))
    )
    return count_by(evaluated, "tenant_id", "verdict")


def rate_hits(decisions: DataFrame) -> DataFrame:
    """Early refusals by tenant and kind: rate or quota."""
    kind = F.when(F.col("error") == "rate_limit_exceeded", "rate").when(
        F.col("error") == "daily_quota_exceeded", "quota"
    )
    return count_by(decisions.withColumn("kind", kind), "tenant_id", "kind")


def stream_aborts(outcomes: DataFrame) -> DataFrame:
    """Aborted streams by tenant."""
    return count_by(outcomes.filter("aborted"), "tenant_id")


def latency_histogram(
    df: DataFrame, value: str, by: list[str], buckets: tuple[float, ...] = V.REQUEST_BUCKETS
) -> DataFrame:
    """Cumulative buckets (`le`, `cumulative`) with `total` and `sum` per label set.

    One pass with partial aggregation; `le` of the last bucket is infinity.
    """
    counted = df.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)],
        F.count(F.col(value)).alias("total"),
        F.sum(value).alias("sum"),
    )
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(buckets)
    ], F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("cumulative")))
    return counted.select(*by, F.inline(rows), "total", "sum")


def ttft_histogram(timing: DataFrame, by: list[str]) -> DataFrame:
    """Time to the first forwarded byte of streams, from their timing rows."""
    seconds = timing.filter(F.col("ttft_us").isNotNull()).withColumn("seconds", F.col("ttft_us") / 1e6)
    return latency_histogram(seconds, "seconds", by, V.TTFT_BUCKETS)


def check_histogram(checks: DataFrame, seconds: str, by: list[str]) -> DataFrame:
    """Logged durations of output checks."""
    return latency_histogram(checks, seconds, by, V.CHECK_BUCKETS)


def histogram_quantile(histogram: DataFrame, by: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket that reaches the rank.

    A rank in the last bucket gives the highest finite bound.
    """
    order = Window.partitionBy(*by).orderBy("le")
    bounded = histogram.withColumn(
        "_low", F.coalesce(F.lag("le").over(order), F.lit(0.0))
    ).withColumn("_below", F.coalesce(F.lag("cumulative").over(order), F.lit(0)))
    rank = F.col("quantile") * F.col("total")
    ranked = bounded.withColumn("quantile", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    share = F.try_divide(rank - F.col("_below"), F.col("cumulative") - F.col("_below"))
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(
        F.col("_low") + (F.col("le") - F.col("_low")) * share
    )
    return (
        ranked.filter((F.col("total") > 0) & (F.col("cumulative") >= rank))
        .groupBy(*by, "quantile")
        .agg(F.min_by(value, F.col("le")).alias("value"))
    )


def rate_per_second(
    events: DataFrame, by: list[str], ts: str = "ts", window_seconds: int = 60, step_seconds: int = 15
) -> DataFrame:
    """Events per second over the trailing window, every step.

    Events are counted per step first; the windows then add up step counts, so no
    event is copied.
    """
    step_us = step_seconds * 1_000_000
    steps = window_seconds // step_seconds
    counts = events.groupBy(*by, slot(micros(F.col(ts)), step_us).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    spread = counts.withColumn("_end", F.explode(F.sequence(F.col("_slot") + 1, F.col("_slot") + steps)))
    return spread.groupBy(*by, "_end").agg(
        (F.sum("_n") / F.lit(float(window_seconds))).alias("per_second")
    ).select(*by, F.timestamp_micros(F.col("_end") * step_us).alias("window_end"), "per_second")


def error_rate(events: DataFrame, by: list[str], ts: str = "ts", **window) -> DataFrame:
    """rate_per_second of answers with a 4xx or 5xx status."""
    return rate_per_second(events.filter(F.col("status").between(400, 599)), by, ts, **window)


def total_requests(decisions: DataFrame) -> DataFrame:
    """Grand total with its display band."""
    total = decisions.agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn(
        "band", F.when(F.col("total") >= 10000, "red").when(F.col("total") >= 1000, "yellow")
        .otherwise("green"),
    )


def exact_ranks(df: DataFrame, value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """(quantile, value): the element at floor((n - 1) * q) of the sorted values.

    Equal values are counted first.  A logarithmic slot of each value (64 powers of two
    by 256, so at most some ten thousand rows in the window over all slots) finds the slot
    that holds each rank; `FINE_SLOTS` even parts of that slot's span find the part, and
    only the values of that part are put in order.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_v").isNotNull()
    )
    slotted = counts.withColumn("_slot", _log_slot(F.col("_v")))
    per_slot = slotted.groupBy("_slot").agg(F.sum("_n").alias("_n"))
    everything = Window.orderBy("_slot")
    bases = per_slot.select(
        "_slot",
        "_n",
        (F.sum("_n").over(everything) - F.col("_n")).alias("_base"),
        F.sum("_n").over(everything.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    ranks = bases.withColumn(
        "quantile", F.explode(F.array(*[F.lit(q) for q in quantiles]))
    ).withColumn("_rank", F.floor((F.col("_total") - 1) * F.col("quantile")))
    wanted = ranks.filter(
        (F.col("_rank") >= F.col("_base")) & (F.col("_rank") < F.col("_base") + F.col("_n"))
    ).select("_slot", "quantile", (F.col("_rank") - F.col("_base")).alias("_offset"))
    inside = slotted.join(wanted, "_slot")
    spans = inside.groupBy("quantile").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    share = F.coalesce(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    fine = inside.join(spans, "quantile").withColumn("_fine", F.floor(share * FINE_SLOTS))
    earlier = Window.partitionBy("quantile").orderBy("_fine")
    per_fine = fine.groupBy("quantile", "_fine").agg(
        F.sum("_n").alias("_in"), F.first("_offset").alias("_rest")
    ).withColumn("_base", F.sum("_in").over(earlier) - F.col("_in"))
    part = per_fine.filter(
        (F.col("_rest") >= F.col("_base")) & (F.col("_rest") < F.col("_base") + F.col("_in"))
    ).select("quantile", "_fine", (F.col("_rest") - F.col("_base")).alias("_place"))
    within = Window.partitionBy("quantile").orderBy("_v")
    return (
        fine.join(part, ["quantile", "_fine"])
        .withColumn("_upto", F.sum("_n").over(within))
        .filter(F.col("_upto") > F.col("_place"))
        .groupBy("quantile")
        .agg(F.min("_v").alias("value"))
    )


def _log_slot(value: Column) -> Column:
    """Order-keeping slot: sign, then a 256th of a power of two of the size."""
    size = F.floor(F.log2(F.abs(value) * 1e9 + 1) * 256)
    return F.when(value < 0, -size).otherwise(size)


def latency_sketches(
    df: DataFrame, value: str, by: list[str], error: float = SKETCH_ERROR
) -> DataFrame:
    """(by, place, n): how many values lie in each step of a geometric scale.

    Steps grow by (1 + error) / (1 - error), so the middle of a step is within `error` of
    all its values.  Counts of parts add up to those of the whole: keep them per tenant and
    day, and merge what a report asks for.  Rows per label set grow with the span of the
    values, at most some 71,000 at an error of 1 %, not with their number.  Place null
    stands for 0 and less, which have no step; nulls are left out.
    """
    step = math.log((1 + error) / (1 - error))
    place = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value)) / F.lit(step)))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, place.alias("place")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser label sets, such as tenants out of tenants and days."""
    return sketches.groupBy(*by, "place").agg(F.sum("n").alias("n"))


def approximate_ranks(
    sketches: DataFrame, by: list[str], quantiles: tuple[float, ...], error: float = SKETCH_ERROR
) -> DataFrame:
    """(by, quantile, n, value): within `error` of the element at floor((n - 1) * quantile).

    `error` is that of the sketches.  Values of 0 and less come out as 0.
    """
    step = math.log((1 + error) / (1 - error))
    order = Window.partitionBy(*by).orderBy(F.col("place").asc_nulls_first())
    ranked = (
        merge_sketches(sketches, by)
        .withColumn("_upto", F.sum("n").over(order))
        .withColumn("_total", F.sum("n").over(Window.partitionBy(*by)))
        .withColumn("quantile", F.explode(F.array(*[F.lit(q) for q in quantiles])))
        .filter(F.col("_upto") > F.floor((F.col("_total") - 1) * F.col("quantile")))
    )
    middle = F.exp(F.col("place") * F.lit(step)) * F.lit(1 - error)
    return ranked.groupBy(*by, "quantile").agg(
        F.first("_total").alias("n"),
        F.min(F.when(F.col("place").isNull(), F.lit(0.0)).otherwise(middle)).alias("value"),
    )


def load_report(requests: DataFrame, latency: str = "seconds", ts: str = "ts") -> DataFrame:
    """One row: sent, ok, errors, throughput, exact percentiles, maximum, error flag."""
    ok = F.col("status").between(200, 299)
    us = micros(F.col(ts))
    totals = requests.agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("errors"),
        F.max(latency).alias("max_latency"),
        ((F.max(us) - F.min(us)) / F.lit(1e6)).alias("_seconds"),
    )
    ranks = exact_ranks(requests, latency, (0.5, 0.95, 0.99)).agg(*[
        F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(name)
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))
    ])
    # Two single rows become one by aggregation.
    parts = totals.unionByName(ranks, allowMissingColumns=True)
    both = parts.agg(*[F.max(name).alias(name) for name in parts.columns])
    return both.select(
        "sent", "ok", "errors",
        F.when(F.col("_seconds") > 0, F.try_divide("ok", "_seconds")).alias("throughput"),
        "p50", "p95", "p99", "max_latency",
        F.coalesce(F.try_divide("errors", "sent") > 0.05, F.lit(False)).alias("too_many_errors"),
    )

"""Token charges and the daily token quota."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import fixed_values as V
from ..functions import rules as R
from ..functions.slots import micros, slot
from ..session import broadcast_if_small, ship_package, write_stage
from .fold_tree import chunk_starts, ranges_of
from .policy import bundles_in_force, with_rules_of_the_time, writing_bundles

SLOT_SECONDS = 1
CHUNK_ROWS = 1_000_000


def charge(prompt: Column, text: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Tokens one completion costs: as reported, else a quarter of the bytes, at least 1."""
    reported = (input_tokens + output_tokens).cast("long")
    estimated = F.floor((F.octet_length(prompt) + F.octet_length(text)) / F.lit(4)).cast("long")
    one = F.lit(1).cast("long")
    return F.when(reported >= 1, reported).otherwise(F.greatest(estimated, one))


def token_usage(requests: DataFrame, path: str = "path") -> DataFrame:
    """Add `tokens`: the charge of a completion, 0 for any other path."""
    cost = charge(
        F.col("prompt"), F.col("response_text"), F.col("input_tokens"), F.col("output_tokens")
    )
    return requests.withColumn(
        "tokens", F.when(F.col(path) == "/v1/complete", cost).otherwise(F.lit(0).cast("long"))
    )


def daily_usage(charged: DataFrame, tenant: str = "tenant_id", ts: str = "ts") -> DataFrame:
    """Tokens and charged requests per tenant and UTC day."""
    return charged.groupBy(tenant, F.to_date(F.col(ts).cast("timestamp")).alias("day")).agg(
        F.sum("tokens").alias("tokens"),
        F.count_if(F.col("tokens") > 0).alias("charged_requests"),
    )


def daily_quota(
    requests: DataFrame,
    limit: int = V.DAILY_TOKENS,
    tenant: str = "tenant_id",
    ts: str = "ts",
    order_id: str = "request_id",
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Add `used_before` and `quota_ok`: less than `limit` charged that day before.

    Once a day's quota is used up it stays so, and refused requests charge nothing;
    so a plain running sum of `tokens` decides.  It is built from sums per second,
    which keeps a busy tenant's day from being one task.  `used_before` is null on
    refused rows.
    """
    rows = (
        requests.withColumn("_us", micros(F.col(ts)))
        .withColumn("_day", F.to_date(F.col(ts).cast("timestamp")))
        .withColumn("_slot", slot(F.col("_us"), slot_seconds * 1_000_000))
        .withColumn("_tenant", F.col(tenant))
    )
    sums = rows.groupBy("_tenant", "_day", "_slot").agg(F.sum("tokens").alias("_sum"))
    earlier = (
        Window.partitionBy("_tenant", "_day").orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = sums.select(
        "_tenant", "_day", "_slot",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
    )
    within = (
        Window.partitionBy("_tenant", "_day", "_slot").orderBy("_us", order_id)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("_base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return (
        rows.join(bases, ["_tenant", "_day", "_slot"])
        .withColumn("_before", before)
        .withColumn("quota_ok", F.col("_before") < limit)
        .withColumn("used_before", F.when(F.col("quota_ok"), F.col("_before")))
        .select(*requests.columns, "used_before", "quota_ok")
    )


def quota_policy_fold(
    requests: DataFrame,
    rules: DataFrame,
    limit: int = V.DAILY_TOKENS,
    tenant: str = "tenant_id",
    ts: str = "ts",
    order_id: str = "request_id",
    slot_seconds: int = SLOT_SECONDS,
    chunk_rows: int = CHUNK_ROWS,
    force_model: str | None = None,
    as_of: bool = False,
) -> DataFrame:
    """Quota and policy where a rule reads the tenant's tokens of the day.

    A policy block removes a charge and so moves all later totals.  Between two
    constants that rules compare the total with, each request's verdict is fixed:
    Spark works out one verdict per such range, and the fold only has to find the
    range each request falls in.

    A day of more than `chunk_rows` rows is cut into chunks that are folded in parallel.
    Each chunk is first summed up as a function from the total before it to the total
    after it; `fold_tree` composes these up a tree and hands every chunk its start.

    With `as_of` each request is judged by the version of its tenant's rules in force at
    its time; the ranges are then those of all versions of the tenant.

    Adds used_before (null if refused by quota), quota_ok, charged, policy_rule,
    policy_action and policy_reason.
    """
    ship_package(requests.sparkSession)
    bundles = writing_bundles(rules) if as_of else bundles_in_force(rules).withColumnRenamed("tenant_id", "_of")
    # Rules are written, so that Spark knows how small they are and moves no requests for them.
    bundles = write_stage(bundles, "rules")
    bounds = bundles.groupBy(F.col("_of").alias("_tenant")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(R.token_bounds(F.col("rules")))))).alias("_bounds")
    )
    bounds = write_stage(bounds.withColumn("_samples", R.token_samples(F.col("_bounds"))), "rule-bounds")
    rows = (
        requests.withColumn("_us", micros(F.col(ts)))
        .withColumn("_day", F.to_date(F.col(ts).cast("timestamp")))
        .withColumn("_slot", slot(F.col("_us"), slot_seconds * 1_000_000))
        .withColumn("_tenant", F.col(tenant))
    )
    before = (
        Window.partitionBy("_tenant", "_day").orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = rows.groupBy("_tenant", "_day", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    chunks = counts.select(
        "_tenant", "_day", "_slot",
        slot(F.coalesce(F.sum("_n").over(before), F.lit(0)), chunk_rows).alias("_chunk"),
    )
    # Only slots beyond a day's first chunk need to be looked up.
    late = write_stage(chunks.filter(F.col("_chunk") > 0), "quota-slots")
    last_chunk = late.agg(F.max("_chunk")).first()[0] or 0

    bounded = rows.join(broadcast_if_small(bounds), "_tenant", "left")
    if as_of:
        with_rules = with_rules_of_the_time(bounded, rules, ts, "_tenant", bundles).withColumnRenamed(
            "in_force", "_in_force"
        )
    else:
        with_rules = bounded.join(
            broadcast_if_small(bundles.withColumnRenamed("_of", "_tenant")), "_tenant", "left"
        )

    model = F.lit(force_model) if force_model else F.col("model")

    def verdict_at(total):
        return R.first_match_index(F.col("rules"), F.col("score"), model, total)

    samples = F.coalesce(F.col("_samples"), R.token_samples(F.array().cast("array<double>")))
    verdicts = F.transform(samples, verdict_at)
    prepared = with_rules.withColumn("_verdicts", verdicts).withColumn(
        "_blocked",
        F.transform(
            F.col("_verdicts"),
            lambda v: F.coalesce(F.get(F.col("rules"), v)["action"] == "BLOCK", F.lit(False)),
        ),
    ).drop("rules", "_samples")
    key = ["_tenant", "_day", "_chunk"]
    if last_chunk:
        prepared = prepared.join(late, ["_tenant", "_day", "_slot"], "left").withColumn(
            "_chunk", F.coalesce(F.col("_chunk"), F.lit(0))
        )
        # Read twice: once to sum up the chunks of long days, once to fold all.
        prepared = write_stage(prepared, "quota-rows")
        long_days = prepared.join(late.select("_tenant", "_day").distinct(), ["_tenant", "_day"], "left_semi")
        starts = chunk_starts(long_days, limit, int(last_chunk), order_id).select(
            *[F.col(k).alias(f"{k}_of") for k in key], "_used"
        )
        same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in key]
        prepared = prepared.join(broadcast_if_small(starts), same, "left").drop(*[f"{k}_of" for k in key])
    else:
        prepared = prepared.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_used", F.lit(0).cast("long"))
    extra = "used_before bigint, quota_ok boolean, charged bigint, _range int"
    schema = T.StructType(
        [f for f in prepared.schema.fields if f.name not in (*_FOLD_ONLY, "_us", "_slot")]
        + T._parse_datatype_string(extra).fields
    )
    # Spark sorts a chunk, and the fold takes it batch by batch.
    result = (
        prepared.repartition(*key)
        .sortWithinPartitions(*key, F.asc_nulls_last("_us"), F.asc_nulls_last(order_id))
        .drop("_us", "_slot")
        .groupBy(*key).applyInArrow(_folder(limit), schema)
    )
    # Rows went through the fold with the places of their rules; names are looked up now.
    own = F.col("_tenant") == F.col("_of")
    if as_of:
        own = own & (F.col("_in_force") == F.col("_writing"))
    named = result.join(broadcast_if_small(bundles), own, "left")
    place = F.get(F.col("_verdicts"), F.col("_range"))
    verdict = F.when(place >= 0, F.get(F.col("rules"), place))
    return named.select(
        *requests.columns,
        "used_before",
        "quota_ok",
        "charged",
        verdict["rule_name"].alias("policy_rule"),
        verdict["action"].alias("policy_action"),
        verdict["reason"].alias("policy_reason"),
    )


_FOLD_ONLY = ("_bounds", "_blocked", "_used", "_day", "_chunk")


def _folder(limit: int):
    """Rows of a chunk in order of time and id, a batch at a time; the total goes along."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = None
        for rows in batches:
            if not rows.num_rows:
                continue
            if used is None:
                used = rows.column("_used")[0].as_py() or 0
            decided, used = _folded(rows, used, limit)
            yield decided

    return fold


def _folded(rows: pa.RecordBatch, used: int, limit: int) -> tuple[pa.RecordBatch, int]:
    n = rows.num_rows
    before = np.zeros(n, dtype=np.int64)
    charged = np.zeros(n, dtype=np.int64)
    ranges = np.full(n, -1, dtype=np.int32)
    bounds = np.array(rows.column("_bounds")[0].as_py() or [], dtype=float)
    tokens = rows.column("tokens").to_numpy(zero_copy_only=False)
    blocked = np.stack(rows.column("_blocked").to_numpy(zero_copy_only=False))
    ends = ranges_of(bounds, limit)
    start = 0
    while start < n and used < limit:
        # Range 2i lies below bound i, range 2i + 1 is bound i itself.
        current = int(np.searchsorted(ends, used, "right"))
        leave = ends[current]
        cost = np.where(blocked[start:, current].astype(bool), 0, tokens[start:])
        after = used + np.cumsum(cost)
        # The row that leaves the range is still judged in it.
        size = min(int(np.searchsorted(after, leave, "left")) + 1, n - start)
        stop = start + size
        before[start:stop] = after[:size] - cost[:size]
        charged[start:stop] = cost[:size]
        ranges[start:stop] = current
        used = int(after[size - 1])
        start = stop
    refused = ranges < 0
    names = [name for name in rows.schema.names if name not in _FOLD_ONLY]
    return pa.RecordBatch.from_arrays(
        [
            *[rows.column(name) for name in names],
            pa.array(before, mask=refused), pa.array(~refused), pa.array(charged), pa.array(ranges, mask=refused),
        ],
        [*names, "used_before", "quota_ok", "charged", "_range"],
    ), used

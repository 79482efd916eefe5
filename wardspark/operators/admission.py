"""Sliding-log rate limit, replayed over a request table.

A request is admitted if fewer than `limit` admitted requests of its tenant lie in
the window that ends with it.  Refused requests take no slot, so each decision
depends on earlier ones.  Most traffic never comes near the limit, though: request
counts per tenant and short time slot tell where the limit can bind at all.

* Where it cannot, every request is admitted and the remaining allowance is a
  window over at most `2 * limit` rows.
* Where it can, neighbouring slots form clusters that no other cluster influences.
  Clusters are folded in time order, packed to about `chunk_rows` rows.  A longer
  cluster is cut into chunks of that size, folded one after the other; the admitted
  requests of the last window carry over from chunk to chunk.  Contested rows are written
  once by chunk, so that a round reads its own chunk only.

Spark sorts a chunk, and a task folds it batch by batch: it holds one batch and the admitted
requests of one window, however many rows a tenant has.  A slot is never cut: one that alone
has more than `chunk_rows` rows is one chunk.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import fixed_values as V
from ..functions.slots import micros, slot
from ..session import ship_package, write_parts, write_stage

SLOTS_PER_WINDOW = 60
CHUNK_ROWS = 1_000_000


def slot_labels(
    rows: DataFrame, limit: int, slots_per_window: int, chunk_rows: int
) -> DataFrame:
    """Per (tenant, slot): can the limit bind, and which cluster and chunk is it in.

    `rows` has _tenant and _slot.  Windows run over slots, not requests.
    """
    counts = rows.groupBy("_tenant", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    by_slot = Window.partitionBy("_tenant").orderBy("_slot")
    near = by_slot.rangeBetween(-slots_per_window, 0)
    ahead = by_slot.rangeBetween(1, slots_per_window)
    marked = (
        counts.withColumn("_contested", F.sum("_n").over(near) > limit)
        # Refusals still shape the allowance one window later.
        .withColumn("_fold", F.max("_contested").over(near))
    )
    gap = F.col("_slot") - F.lag("_slot").over(by_slot)
    fresh = F.coalesce((gap > slots_per_window) | ~F.lag("_fold").over(by_slot), F.lit(True))
    until = by_slot.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_slot.rowsBetween(Window.unboundedPreceding, -1)
    counted = marked.withColumn("_head", F.col("_fold") & fresh).withColumn(
        "_before", F.coalesce(F.sum(F.when(F.col("_fold"), F.col("_n"))).over(earlier), F.lit(0))
    )
    first = F.when(F.col("_head"), F.col("_before"))
    packed = counted.withColumn("_first", F.max(first).over(until)).withColumn(
        "_pack", slot(F.col("_first"), chunk_rows)
    ).withColumn(
        # The admitted requests just before a cluster are its starting state.
        "_leads_to", slot(F.min(first).over(ahead), chunk_rows)
    )
    folded_there = F.col("_fold") & (F.col("_pack") == F.col("_leads_to"))
    return packed.select(
        "_tenant",
        "_slot",
        "_contested",
        "_fold",
        "_pack",
        slot(F.col("_before") - F.col("_first"), chunk_rows).alias("_chunk"),
        F.when(~F.coalesce(folded_there, F.lit(False)), F.col("_leads_to")).alias("_leads_to"),
    )


def admit(
    requests: DataFrame,
    limit: int = V.REQUESTS_PER_MINUTE,
    window_seconds: float = 60.0,
    tenant: str = "tenant_id",
    ts: str = "ts",
    order_id: str = "request_id",
    slots_per_window: int = SLOTS_PER_WINDOW,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add `admitted` and `remaining` (0 if refused); ties in time go by `order_id`.

    Pass narrow rows: the columns travel through the shuffles.
    """
    window_us = int(window_seconds * 1_000_000)
    slot_us = max(1, -(-window_us // slots_per_window))
    slots = -(-window_us // slot_us)
    rows = (
        requests.withColumn("_us", micros(F.col(ts)))
        .withColumn("_slot", slot(F.col("_us"), slot_us))
        .withColumn("_tenant", F.col(tenant))
    )

    labels = slot_labels(rows.select("_tenant", "_slot"), limit, slots, chunk_rows)
    hot = write_stage(
        labels.filter(F.col("_fold") | F.col("_leads_to").isNotNull()), "rate-slots"
    )
    last_chunk = hot.filter("_fold").agg(F.max("_chunk")).first()[0]
    out_columns = [*requests.columns, "admitted", "remaining"]
    if last_chunk is None:
        return _uncontested(rows, limit, window_us, order_id).select(*out_columns)

    marked = rows.join(hot, ["_tenant", "_slot"], "left")
    calm = _uncontested(
        marked.filter(~F.coalesce(F.col("_contested"), F.lit(False))),
        limit, window_us, order_id,
    ).filter(~F.coalesce(F.col("_fold"), F.lit(False)))
    folded = _fold_chunks(rows, hot, int(last_chunk), limit, window_us, slot_us, order_id)
    return calm.select(*out_columns).unionByName(folded.select(*out_columns))


def _uncontested(rows: DataFrame, limit: int, window_us: int, order_id: str) -> DataFrame:
    """Rows that are all admitted, with the allowance each leaves.

    Rows are grouped by window-long buckets and also copied to the next bucket,
    which needs them as its past.
    """
    bucket = slot(F.col("_us"), window_us)
    spread = rows.withColumn("_home", bucket).withColumn(
        "_bucket", F.explode(F.array(bucket, bucket + 1))
    )
    group = Window.partitionBy("_tenant", "_bucket")
    rank = F.row_number().over(group.orderBy("_us", order_id))
    expired = F.count(F.lit(1)).over(
        group.orderBy("_us").rangeBetween(Window.unboundedPreceding, -window_us)
    )
    return (
        spread.withColumn("_rank", rank)
        .withColumn("remaining", F.lit(limit).cast("long") - (F.col("_rank") - expired))
        .withColumn("admitted", F.lit(True))
        .filter(F.col("_home") == F.col("_bucket"))
    )


def _fold_chunks(
    rows: DataFrame, hot: DataFrame, last_chunk: int, limit: int, window_us: int,
    slot_us: int, order_id: str,
) -> DataFrame:
    """Fold every pack chunk by chunk; all packs of one round run in parallel.

    Times and ids go through the rounds, and the admitted ones come out; other columns stay
    where they are and are joined to what was admitted.
    """
    ship_package(rows.sparkSession)
    fold_slots = hot.filter("_fold").select("_tenant", "_slot", "_pack", "_chunk")
    lead_slots = hot.filter(F.col("_leads_to").isNotNull()).select(
        "_tenant", "_slot", F.col("_leads_to").alias("_pack")
    )
    narrow = ["_tenant", "_pack", "_us", order_id, "_past"]
    past = rows.join(lead_slots, ["_tenant", "_slot"]).withColumn("_past", F.lit(True)).select(*narrow)
    contested = rows.join(fold_slots, ["_tenant", "_slot"]).withColumn("_past", F.lit(False)).select(
        *narrow, "_chunk"
    )
    if last_chunk:
        contested = write_parts(contested, "rate-rows", "_chunk")
        past = write_stage(past, "rate-leads")
    schema = T.StructType(
        [f for f in past.schema.fields if f.name != "_past"] + [T.StructField("_left", T.LongType())]
    )
    admitted = []
    for chunk in range(last_chunk + 1):
        current = contested.filter(F.col("_chunk") == chunk).select(*narrow)
        ordered = current.unionByName(past).repartition("_tenant", "_pack").sortWithinPartitions(
            "_tenant", "_pack", F.asc_nulls_last("_us"), F.asc_nulls_last(order_id)
        )
        taken = write_stage(
            ordered.groupBy("_tenant", "_pack").applyInArrow(_folder(limit, window_us), schema),
            f"rate-chunk-{chunk}",
        )
        admitted.append(taken)
        if chunk == last_chunk:
            break
        starts = (
            # A full slot may skip chunk numbers: the state waits for the next one.
            fold_slots.filter(F.col("_chunk") > chunk)
            .groupBy("_tenant", "_pack")
            .agg((F.min("_slot") * slot_us - window_us).alias("_from"))
        )
        past = (
            taken.drop("_left").withColumn("_past", F.lit(True)).unionByName(past)
            .join(starts, ["_tenant", "_pack"])
            .filter(F.col("_us") > F.col("_from"))
            .drop("_from")
        )
        past = write_stage(past, f"rate-past-{chunk}")
    return _marked(rows.join(fold_slots.select("_tenant", "_slot"), ["_tenant", "_slot"]), admitted, order_id)


def _marked(rows: DataFrame, admitted: list[DataFrame], order_id: str) -> DataFrame:
    """Contested rows with `admitted` and `remaining`.  Of rows alike in tenant, time and id
    as many are admitted as the fold says; it does not matter which."""
    taken = admitted[0]
    for more in admitted[1:]:
        taken = taken.unionByName(more)
    allowed = write_stage(
        taken.groupBy(F.col("_tenant").alias("_of"), F.col("_us").alias("_at"), F.col(order_id).alias("_id"))
        .agg(F.sort_array(F.collect_list("_left"), asc=False).alias("_left")),
        "rate-admitted",
    )
    same = (F.col("_of") == F.col("_tenant")) & (F.col("_at") == F.col("_us")) & F.col("_id").eqNullSafe(F.col(order_id))
    refused = rows.join(allowed, same, "left_anti").select(
        "*", F.lit(False).alias("admitted"), F.lit(0).cast("long").alias("remaining")
    )
    alike = Window.partitionBy("_tenant", "_us", order_id).orderBy("_slot")
    left = F.get("_left", F.row_number().over(alike) - 1)
    known = rows.join(allowed, same).withColumn("_left", left)
    return refused.unionByName(known.select(
        *rows.columns, F.col("_left").isNotNull().alias("admitted"),
        F.coalesce("_left", F.lit(0).cast("long")).alias("remaining"),
    ))


def _folder(limit: int, window_us: int):
    """Rows of a pack in order of time and id, a batch at a time: out go the admitted ones."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[int] = []
        live = 0  # taken[live:] lies in the window of the latest request
        for batch in batches:
            is_past = batch.column("_past").to_numpy(zero_copy_only=False)
            us = batch.column("_us").to_numpy()
            n = len(us)
            past_at = np.append(np.flatnonzero(is_past), n)
            rows, left, i = [], [], 0
            while i < n:
                now = int(us[i])
                if not is_past[i]:
                    room_from = taken[-limit] + window_us if 0 < limit <= len(taken) else now
                    if limit <= 0 or room_from > now:
                        # Everything up to the next row with room, or known row, is refused.
                        next_past = past_at[np.searchsorted(past_at, i)]
                        free = np.searchsorted(us, room_from, "left") if limit > 0 else n
                        i = int(min(free, next_past))
                        continue
                taken.append(now)
                while taken[live] <= now - window_us:
                    live += 1
                if not is_past[i]:
                    rows.append(i)
                    left.append(limit - (len(taken) - live))
                i += 1
            spent = max(min(live, len(taken) - limit), 0)
            taken, live = taken[spent:], live - spent
            kept = batch.drop_columns(["_past"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(left, pa.int64())], [*kept.schema.names, "_left"]
            )

    return fold

"""Operator 8: a reproducible shuffle by a Feistel permutation of global row numbers.

Rows are numbered in a fixed order (doc_id with nulls first, then size, then hash of the
text), the numbers are permuted by a keyed Feistel network with cycle walking, and shard
and slot are the remainder and quotient of the permuted number.  Both can be computed for
any row number without looking at other rows, and counts differ by at most one.

Only ids, sizes and checksums are shuffled, never texts.  Null text counts as empty,
repeated rows are numbered in any order among themselves, an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_broadcast, splits_for, stage

ROUNDS = 4
MAX_WALK = 64


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number rows from 0 in the given order, without a global window; also the count.

    Rows are range-partitioned by the order and written, each part is numbered by itself,
    and the parts' counts (one row per part) give the offsets.  A column that only tells
    equal rows apart lets Spark cut a run of equal rows between parts.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    parts = stage(
        tied.repartitionByRange(splits_for(df), *keys).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    counts = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "offsets"
    )
    total = offsets.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    numbered = parts.join(bounded_broadcast(offsets.drop("_rows")), "_part").withColumn(
        name, F.col("_before") + within - 1
    )
    return numbered.drop("_tie", "_part", "_before"), int(total)


def feistel(value: Column, total: int, key: str, rounds: int = ROUNDS) -> Column:
    """Permute 0..total-1.

    The domain is a x b, the least rectangle of nearly equal sides that holds `total`
    numbers; a value beyond `total` is permuted again until it is inside.  A walk has at
    most a*b-total+1 steps and leaves with odds of about 1/sqrt(total) each time, so
    `MAX_WALK` steps are exact below 4,096 rows and enough beyond: a walk of 64 steps has
    odds under 64**-64.
    """
    if total <= 1:
        return value
    a = math.isqrt(total - 1) + 1
    b = -(-total // a)

    def once(v: Column) -> Column:
        pair = F.struct((v % a).alias("l"), F.floor(v / a).cast("long").alias("r"))

        def step(state: Column, number: Column) -> Column:
            return F.when(
                number % 2 == 0,
                F.struct(
                    ((state["l"] + _mixed(state["r"], number, key, a)) % a).alias("l"),
                    state["r"].alias("r"),
                ),
            ).otherwise(
                F.struct(
                    state["l"].alias("l"),
                    ((state["r"] + _mixed(state["l"], number, key, b)) % b).alias("r"),
                )
            )

        return F.aggregate(
            F.array(*[F.lit(n).cast("long") for n in range(rounds)]),
            pair, step, lambda s: s["l"] + s["r"] * a,
        )

    steps = min(a * b - total + 1, MAX_WALK)
    walk = F.array(*[F.lit(n) for n in range(steps)])
    return F.aggregate(
        walk, F.lit(-1).cast("long"),
        lambda v, n: F.when((n > 0) & (v < total), v).otherwise(once(F.when(n == 0, value).otherwise(v))),
    )


def _mixed(value: Column, number: Column, key: str, modulus: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(key), number.cast("string"), value.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % modulus


def shard_rows(
    rows: DataFrame, order: list[str], shards: int, key: str = "shuffle"
) -> DataFrame:
    """Add `position` (the permuted row number), `shard` and `slot` to every row."""
    numbered, total = row_numbers(rows, order)
    placed = numbered.withColumn("position", feistel(F.col("row_number"), total, key))
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn(
        "slot", F.floor(F.col("position") / shards).cast("long")
    )


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "shuffle") -> DataFrame:
    """One row per document with its size, checksum, shard and slot (law `rows`)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(text).alias("_digest"),
    )
    placed = shard_rows(narrow, ["doc_id", "size", "_digest"], shards, key)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Operator 12: mix sources to target weights along a curriculum that changes over time.

Every source has a weight schedule over training time 0 to 1: straight lines between
knots.  The integral of a schedule is the source's weight.  The mix holds `share` times
all words; weights divide them, no source gives more than `most` times what it has, and
what is above that is shared again by weight until no source is above.

The documents of a source follow each other in the order of a hash, again and again, and
so number its words.  The words below the source's target are taken; the last copy is cut
there.  A source has given a share x of its target when its schedule's integral has
reached x of the whole, so the position of a copy in training is that integral inverted at
the copy's first word.  Documents are range-sorted by position.

Words are numbered without a group per source: rows are range-partitioned by source and
hash into ranges of `RANGE_ROWS` rows, each range is summed up by itself, and sums of
ranges give the offsets.  Only ids, sizes and hashes move.

Null text has no words; a document without words is never taken.  A null source is a
source, the last one.  Repeated rows are taken one by one, in any order among themselves;
rows of one doc_id (null, too) are in order of size and hash of the text.  A mix of no
words has targets of 0; an empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_broadcast, stage
from .sharding import row_numbers

# Weight over time as (time, weight) knots; sources in turn take one of these.
SCHEDULES = (
    ((0.0, 4.0), (0.5, 3.0), (1.0, 2.0)),  # weight 3, early
    ((0.0, 1.0), (1.0, 1.0)),              # weight 1, throughout
    ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)),  # weight 2, late
)
SHARE, MOST = 1.5, 2
RANGE_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"

Schedule = Sequence[tuple[float, float]]


def areas(schedule: Schedule) -> list[float]:
    """Integral of a schedule up to each of its knots."""
    total, found = 0.0, [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        total += (t1 - t0) * (w0 + w1) / 2
        found.append(total)
    return found


def invert(schedule: Schedule, share: Column) -> Column:
    """Time at which the schedule's integral has reached `share` of the whole."""
    before = areas(schedule)
    reached = share * F.lit(before[-1])
    time = F.lit(schedule[-1][0])
    for k in reversed(range(len(schedule) - 1)):
        (t0, w0), (t1, w1) = schedule[k : k + 2]
        rest = reached - F.lit(before[k])
        root = F.sqrt(F.lit(w0 * w0) + rest * F.lit(2 * (w1 - w0) / (t1 - t0)))
        within = F.when(rest <= 0, F.lit(t0)).otherwise(F.lit(t0) + rest * 2 / (F.lit(w0) + root))
        time = F.when(reached < before[k + 1], within).otherwise(time)
    return time


def share_out(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add `target` to staged sources(source_size, weight).

    `level` is what one unit of weight gets.  Sources that this takes beyond their most
    keep that, the rest is shared again; the level only rises, until no more are beyond.
    """
    full = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    words, weight = full[0] or 0, full[1] or 1.0
    wanted, cap = words * share, F.col("source_size") * most
    level, held, held_before = wanted / weight, 0, -1
    while held != held_before:
        beyond = F.col("weight") * F.lit(level) > cap
        capped, left, now = sources.agg(
            F.sum(F.when(beyond, cap).otherwise(0)), F.sum(F.when(~beyond, F.col("weight"))),
            F.count_if(beyond),
        ).first()
        held_before, held = held, now
        if left:
            level = (wanted - capped) / left
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def _of_kind(kinds: Sequence, kind: Column, column) -> Column:
    """column(k) for the schedule number k of the row."""
    chosen = F.when(kind == 0, column(0))
    for k in range(1, len(kinds)):
        chosen = chosen.when(kind == k, column(k))
    return chosen


def place_copies(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, most: int = MOST,
    key: str = "mix", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, source, size, digest, source_size, target, copies: one row per document.

    `copies` has a (copy, position, words) for each time that words of it are taken.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat(F.lit(f"{key}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    narrow = stage(docs.select(
        "doc_id", F.col("source").isNull().alias("last"), "source",
        F.md5(name).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(text).alias("text_digest"),
    ), "sizes").withColumn("tie", F.monotonically_increasing_id())
    order = ["digest", "doc_id", "size", "text_digest", "tie"]
    ranges = stage(
        narrow.repartitionByRange(max(1, -(-narrow.count() // range_rows)), "last", "source", *order)
        .withColumn("range", F.spark_partition_id()),
        "ranges",
    )
    sums = stage(ranges.groupBy("range", "last", "source").agg(F.sum("size").alias("words")), "sums")

    totals = sums.groupBy("last", "source").agg(F.sum("words").alias("source_size"))
    numbered, _ = row_numbers(totals, ["last", "source"])
    kind = F.col("row_number") % len(schedules)
    weight = _of_kind(schedules, kind, lambda k: F.lit(areas(schedules[k])[-1]))
    sources = stage(
        numbered.select("source", "source_size", kind.cast("int").alias("kind"), weight.alias("weight")), "sources"
    )
    targets = share_out(sources, share, most).drop("weight").withColumnRenamed("source", "of_source")

    earlier = Window.partitionBy("last", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("range").alias("of_range"), F.col("source").alias("in_source"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"),
    ).join(bounded_broadcast(targets), F.col("in_source").eqNullSafe(F.col("of_source"))).drop("of_source")
    offsets = stage(offsets, "offsets")

    within = Window.partitionBy("range", "source").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    running = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    counted = ranges.withColumn("running", running).join(
        bounded_broadcast(offsets),
        (F.col("range") == F.col("of_range")) & F.col("source").eqNullSafe(F.col("in_source")),
    )
    start = F.col("before") + F.col("running") - F.col("size")
    demand = F.round("target").cast("long")

    def copy(k: int) -> Column:
        at = start + F.col("source_size") * k
        given = F.try_divide(at.cast("double"), F.col("target"))
        words = F.greatest(F.least(demand - at, F.col("size")), F.lit(0))
        position = _of_kind(schedules, F.col("kind"), lambda n: invert(schedules[n], given))
        return F.struct(F.lit(k).alias("copy"), position.alias("position"), words.alias("words"))

    copies = F.filter(F.array(*[copy(k) for k in range(most)]), lambda c: c["words"] > 0)
    return counted.select("doc_id", "source", "size", "digest", "source_size", "target", copies.alias("copies"))


def training_order(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, copy, position, words: what the mix reads, sorted by position."""
    placed = place_copies(docs, **settings).withColumn("taken", F.explode("copies"))
    return placed.select("doc_id", "source", "taken.*", "digest").orderBy(
        "position", "digest", "doc_id", "copy"
    ).drop("digest")


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """One row per document, with the words taken of it, sorted by its first position.

    `position` is null for documents that the mix leaves out; they come last.
    """
    placed = place_copies(docs, **settings)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    position = F.get("copies", F.lit(0))["position"]
    return placed.withColumns({"taken": taken, "position": position}).orderBy(
        F.col("position").asc_nulls_last(), "digest", "doc_id"
    ).select("doc_id", "size", "source_size", "target", "taken", "position")

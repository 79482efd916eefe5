"""Operator 4: hierarchical residual packing of token pieces into sequences.

Pieces are spread over parts of bounded size and packed best-fit in each part, longest
first.  Bins too full for the shortest piece there is are done.  The underfull bins, one
number each, are items of the next round, where fewer parts are merged and packed again,
and so on up a tree, until one part is left, or no bins join in parts that are not larger
than those before.

Only ids, lengths and checksums move; the largest group is `part_items` pieces, whatever
their keys.  A null text is one closing token; an empty table gives no rows; repeated rows
are packed one by one, and all their pieces carry the same doc_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .common import stage
from .tokens import token_pieces

CAPACITY = 2048
PART_ITEMS = 40_000
FAN_IN = 8


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every item, and the fill of every bin; longest items first.

    Open bins are listed by room; a bit set of the rooms in use finds the least room that
    holds an item.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += length
        left = room - length
        by_room[left].append(chosen)
        rooms |= 1 << left
    return bins, offsets, fills


def _pack_round(items: DataFrame, parts: int, capacity: int) -> DataFrame:
    """items(item, length) -> item, bin, offset, fill; bins are numbered across parts."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "item"], ascending=[False, True])
        bins, offsets, fills = best_fit(group["length"].to_numpy(), capacity)
        first = np.zeros(len(fills), dtype=np.int64)
        names = group["item"].to_numpy()
        opening = offsets == 0
        first[bins[opening]] = names[opening]  # a bin is named by the item that opened it
        return pd.DataFrame({
            "item": names, "bin": first[bins], "offset": offsets,
            "fill": np.asarray(fills, dtype=np.int64)[bins],
        })

    part = F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")
    return (
        items.select("item", "length", part)
        .groupBy("part")
        .applyInPandas(pack, "item long, bin long, offset long, fill long")
    )


def pack_items(
    items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """items(item long, length long) with distinct items -> item, bin, offset."""
    shortest, count = items.agg(F.min("length"), F.count("*")).first()
    if not count:
        return items.select("item", F.col("item").alias("bin"), F.col("length").alias("offset"))
    parts = -(-count // part_items)
    packed = stage(_pack_round(items, parts, capacity), "packed")
    while parts > 1:
        under = packed.where((F.col("offset") == 0) & (F.col("fill") <= capacity - shortest))
        bins = under.select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        before = bins.count()
        if not before:
            break
        fewer = max(-(-parts // fan_in), -(-before // part_items))
        merged = stage(_pack_round(bins, fewer, capacity), "merged").select(
            F.col("item").alias("bin"), F.col("bin").alias("into"),
            F.col("offset").alias("shift"), F.col("fill").alias("filled"),
        )
        after = merged.where("shift = 0").count()
        packed = stage(
            packed.join(merged, "bin", "left").select(
                "item", F.coalesce("into", "bin").alias("bin"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
                F.coalesce("filled", "fill").alias("fill"),
            ),
            "packed",
        )
        if after == before and fewer >= parts:
            break
        parts = fewer
    return packed.select("item", "bin", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **settings) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    ship_package(docs.sparkSession)
    pieces = stage(
        token_pieces(docs, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces"
    )
    whole = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    placed = rest.join(pack_items(rest.select("item", "length"), capacity, **settings), "item")
    full = whole.withColumns({"bin": F.col("item"), "offset": F.lit(0).cast("long")})
    return full.unionByName(placed).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )

"""Day totals at the start of every chunk, without going through the chunks one by one.

A chunk of requests maps the day's total before it to the total after it.  As totals only
grow, and within a range of totals each request costs the same whatever the total, that
map is a list of intervals each with a shift; totals that reach the limit stay there.
Maps of neighbouring chunks compose to one of the same form, so a day of n chunks takes
2 * log(n) / log(FAN) rounds.  A map has at most as many intervals as the limit has tokens,
and at most about one per request and range.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import write_stage

FAN = 8
FULL = -1  # in place of a shift: the limit is reached


def ranges_of(bounds: np.ndarray, limit: int) -> np.ndarray:
    """First whole total above each range: below bound 0, at it, below bound 1, ...; capped
    at the limit.  A range without whole totals ends where the one before it does."""
    ends = np.column_stack([np.ceil(bounds), np.floor(bounds) + 1]).reshape(-1)
    return np.append(np.clip(ends, 0, limit), limit).astype(np.int64)


def chunk_map(tokens: np.ndarray, blocked: np.ndarray, bounds: np.ndarray, limit: int):
    """(low, shift): total t in [low[i], low[i + 1]) becomes t + shift[i], or FULL.

    `tokens` and `blocked` (request by range) are in the order of the requests.  Intervals
    go up through the ranges; in each they are cut by the request that leaves it.
    """
    n = len(tokens)
    # Intervals [low, high) of the total before, the requests behind them, and their shift.
    low, high = np.zeros(1, dtype=np.int64), np.full(1, limit, dtype=np.int64)
    row, shift = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for current, leave in enumerate(ranges_of(bounds, limit).tolist()):
        inside = low + shift < leave
        if not inside.any():
            continue
        cost = np.where(blocked[:, current], 0, tokens)
        total = np.concatenate([[0], np.cumsum(cost)])
        steps = np.flatnonzero(cost > 0) + 1  # requests handled when the total has grown
        grown = total[steps]

        a, z, k, s = low[inside], np.minimum(high[inside], leave - shift[inside]), row[inside], shift[inside]
        beyond = high > leave - shift
        rest = np.where(inside, leave - shift, low)[beyond], high[beyond], row[beyond], shift[beyond]
        need = leave + total[k]  # leaves with the first step that has total >= need - t
        first = np.searchsorted(grown, need - (z - 1 + s), "left")
        last = np.searchsorted(grown, need - (a + s), "left")
        piece, at = _spread(last - first + 1)
        step = last[piece] - at  # later steps belong to lower totals
        stays = step == len(grown)
        edge = np.append(grown, 0)
        lowest = need[piece] - edge[step] - s[piece]
        highest = need[piece] - np.where(step > 0, edge[step - 1], 0) - s[piece]
        new_low = np.where(stays, a[piece], np.maximum(lowest, a[piece]))
        new_high = np.where(step > first[piece], np.minimum(highest, z[piece]), z[piece])
        after = np.append(steps, n)[step]
        new_shift = s[piece] + total[after] - total[k[piece]]
        done.append((new_low[stays], new_shift[stays]))
        low, high, row, shift = (
            np.concatenate([old, new[~stays]])
            for old, new in zip(rest, (new_low, new_high, after, new_shift))
        )
    done.append((low, np.full(len(low), FULL, dtype=np.int64)))
    return _tidy(np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]))


def compose(first, second, limit: int):
    """The map of two neighbouring chunks, the earlier one first."""
    low, shift = first
    high = np.append(low[1:], limit)
    full = shift == FULL
    reached = low[~full] + shift[~full]
    begin = np.searchsorted(second[0], reached, "right") - 1
    end = np.searchsorted(second[0], reached + (high - low)[~full] - 1, "right") - 1
    piece, at = _spread(end - begin + 1)
    part, moved = begin[piece] + at, shift[~full][piece]
    cut = np.maximum(second[0][part] - moved, low[~full][piece])
    then = second[1][part]
    return _tidy(
        np.concatenate([cut, low[full]]),
        np.concatenate([np.where(then == FULL, FULL, moved + then), shift[full]]),
    )


def value_at(mapping, total: int, limit: int) -> int:
    """The total after, `limit` where it is reached."""
    if total >= limit:
        return limit
    low, shift = mapping
    moved = int(shift[np.searchsorted(low, total, "right") - 1])
    return limit if moved == FULL else total + moved


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index repeated by its count, and the place within the repeats."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def _tidy(low: np.ndarray, shift: np.ndarray):
    """In order, neighbours of one shift made one."""
    order = np.argsort(low, kind="stable")
    low, shift = low[order], shift[order]
    fresh = np.append(True, shift[1:] != shift[:-1])
    return low[fresh], shift[fresh]


def chunk_starts(rows: DataFrame, limit: int, last_chunk: int, order_id: str) -> DataFrame:
    """(_tenant, _day, _chunk, _used): the total at the start of each chunk of `rows`.

    `rows` carry _tenant, _day, _chunk, _us, tokens, _bounds and _blocked; `last_chunk` is
    the highest chunk number, which gives the height of the tree.
    """
    key = ["_tenant", "_day"]
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    map_schema = f"{types}, _chunk bigint, _low array<bigint>, _shift array<bigint>"
    start_schema = f"{types}, _chunk bigint, _used bigint"

    narrow = rows.select(*key, "_chunk", "_us", order_id, "tokens", "_bounds", "_blocked")
    maps = narrow.groupBy(*key, "_chunk").applyInArrow(_summing(limit, order_id), map_schema)
    levels = [write_stage(maps, "quota-maps")]
    nodes = last_chunk + 1
    while nodes > FAN:
        above = levels[-1].groupBy(*key, (F.floor(F.col("_chunk") / FAN)).alias("_node"))
        levels.append(write_stage(above.applyInArrow(_joining(limit), map_schema), "quota-maps"))
        nodes = -(-nodes // FAN)

    roots = levels[-1].select(*key).distinct().select(
        *key, F.lit(0).cast("long").alias("_chunk"), F.lit(0).cast("long").alias("_used")
    )
    starts = roots
    for level in reversed(levels):
        below = level.groupBy(*key, F.floor(F.col("_chunk") / FAN).alias("_node"))
        starts = write_stage(
            below.cogroup(starts.groupBy(*key, F.col("_chunk").alias("_node")))
            .applyInArrow(_walking(limit), start_schema),
            "quota-starts",
        )
    return starts


def _mapping(table: pa.Table, i: int):
    return (table["_low"][i].values.to_numpy(zero_copy_only=False),
            table["_shift"][i].values.to_numpy(zero_copy_only=False))


def _row_of(table: pa.Table, chunk: int, mapping) -> pa.Table:
    return pa.table({
        "_tenant": table["_tenant"].slice(0, 1),
        "_day": table["_day"].slice(0, 1),
        "_chunk": pa.array([chunk], pa.int64()),
        "_low": pa.array([mapping[0]], pa.list_(pa.int64())),
        "_shift": pa.array([mapping[1]], pa.list_(pa.int64())),
    })


def _summing(limit: int, order_id: str):
    def sum_up(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_us", "ascending"), (order_id, "ascending")])
        bounds = np.array(table["_bounds"][0].as_py() or [], dtype=float)
        blocked = np.stack(table["_blocked"].to_numpy(zero_copy_only=False)).astype(bool)
        mapping = chunk_map(table["tokens"].to_numpy(), blocked, bounds, limit)
        return _row_of(table, table["_chunk"][0].as_py(), mapping)

    return sum_up


def _joining(limit: int):
    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        joined = _mapping(table, 0)
        for i in range(1, table.num_rows):
            joined = compose(joined, _mapping(table, i), limit)
        return _row_of(table, table["_chunk"][0].as_py() // FAN, joined)

    return join


def _walking(limit: int):
    def walk(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        used = start["_used"][0].as_py() if start.num_rows else 0
        starts = []
        for i in range(table.num_rows):
            starts.append(used)
            used = value_at(_mapping(table, i), used, limit)
        return table.select(["_tenant", "_day", "_chunk"]).append_column("_used", pa.array(starts, pa.int64()))

    return walk

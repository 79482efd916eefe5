"""The same decisions on unbounded streams.

Scans are stateless and run as they are on a streaming DataFrame.  The rate limit,
the daily quota and the hold-back buffer keep a small keyed state: at most `limit`
times per tenant, one total per tenant and day, `window` bytes per stream, and the
rows that the watermark has not passed.  `sources.tables.split_late` puts rows that
come later than the watermark into a table of their own before any of these drops them.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import batches
from ..functions import fixed_values as V
from ..operators import metrics, policy, scan
from ..session import ship_package
from ..sources.tables import closing_row, once_written


def live_input_scan(requests: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Score and verdict of each prompt as it arrives."""
    return scan.input_scan(requests, text_col, keep).drop("signals")


def live_decisions(scored: DataFrame, load_rules, write_batch, rules_folder: str | None = None):
    """Writer that judges each micro-batch by the rules in force when it starts.

    `load_rules()` returns the rule table; a batch finishes with the rules it began
    with.  `write_batch(decisions, batch_id)` must be idempotent per batch id.

    With `rules_folder` the rules a batch begins with are written there under its number
    and read from there, so a batch that runs again after a failure judges as it did
    before, whatever the rules are by then.  A folder there also tells which rules
    judged which batch.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        if rules_folder:
            rules = once_written(batch.sparkSession, f"{rules_folder}/batch={batch_id}", load_rules)
        else:
            rules = load_rules()
        write_batch(policy.evaluate_tenant_policies(batch, rules), batch_id)

    return scored.writeStream.foreachBatch(judge)


def live_counters(
    events: DataFrame, by: list[str], ts: str = "ts", window: str = "1 minute",
    watermark: str = "10 minutes",
) -> DataFrame:
    """Events per label set and window."""
    return (
        events.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), *by, "n")
    )


def live_histogram(
    events: DataFrame, value: str, by: list[str], buckets=V.REQUEST_BUCKETS, ts: str = "ts",
    window: str = "1 minute", watermark: str = "10 minutes",
) -> DataFrame:
    """Cumulative latency buckets per label set and window."""
    windowed = events.withWatermark(ts, watermark).withColumn("window", F.window(ts, window))
    return metrics.latency_histogram(windowed, value, ["window", *by], buckets)


def _types(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{name} {df.schema[name].dataType.simpleString()}" for name in names)


PART_ROWS = 10_000  # decided rows that leave the operator at once


class _Held:
    """Rows of one key that wait for the watermark, in order of time and id.

    A row is decided once no row before it can come any more; until then it is part of
    the state, which so holds the rows of the last `watermark` of its key.  They are kept
    as Arrow columns, in one binary value, and taken out in parts.
    """

    def __init__(self, state: GroupState, schema: pa.Schema):
        self.schema, self.state, self.last = schema, state, []
        self.tables = []
        if state.exists:
            rows, last = state.get
            self.tables.append(pa.ipc.open_stream(bytes(rows)).read_all())
            self.last = list(last)

    def add(self, batches) -> None:
        for batch in batches:
            if len(batch):
                columns = [pa.array(batch[f.name], f.type, from_pandas=True) for f in self.schema]
                self.tables.append(pa.table(columns, schema=self.schema))

    def due(self):
        """Rows up to the watermark, taken out of the state in order, a part at a time."""
        rows = pa.concat_tables(self.tables) if self.tables else self.schema.empty_table()
        self.tables = []
        rows = rows.sort_by([(name, "ascending") for name in self.schema.names])
        upto = self.state.getCurrentWatermarkMs() * 1000
        ready = int(np.searchsorted(rows["us"].to_numpy(), upto, "right"))
        self.rows = rows.slice(ready)
        for at in range(0, ready, PART_ROWS):
            part = rows.slice(at, min(PART_ROWS, ready - at))
            yield list(zip(*[column.to_pylist() for column in part.columns]))

    def waits(self) -> bool:
        return self.rows.num_rows > 0

    def keep(self, last: list, expires_ms: int | None) -> None:
        """Store what is left; wake up when the next row is due, or drop a spent state."""
        if not self.waits() and expires_ms is None:
            self.state.remove()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as stream:
            stream.write_table(self.rows)
        self.state.update((sink.getvalue().to_pybytes(), last))
        wake = self.rows["us"][0].as_py() // 1000 if self.waits() else expires_ms
        self.state.setTimeoutTimestamp(max(int(wake) + 1, self.state.getCurrentWatermarkMs() + 1))


def _waiting(df: DataFrame, *names: str) -> pa.Schema:
    return to_arrow_schema(df.select(*names).schema)


def live_rate_limit(
    requests: DataFrame, limit: int = V.REQUESTS_PER_MINUTE, window_seconds: float = 60.0,
    watermark: str = "10 minutes",
) -> DataFrame:
    """(tenant_id, request_id, us, admitted, remaining) of each request, in event time.

    Requests are decided in order of time and id once the watermark has passed them, so
    the order of arrival does not matter.  The state is the tenant's undecided requests
    and the admitted times of the last window.
    """
    ship_package(requests.sparkSession)
    window_us = int(window_seconds * 1_000_000)
    narrow = requests.withWatermark("ts", watermark).select(
        "tenant_id", "ts", F.unix_micros("ts").alias("us"), "request_id"
    )
    schema = _waiting(narrow, "us", "request_id")

    def step(key, batches, state: GroupState):
        if key[0] is None:  # the row that closes an input, and requests of no tenant
            return
        held = _Held(state, schema)
        held.add(batches)
        times, begin = held.last, 0
        for part in held.due():
            out = []
            for us, request in part:
                while begin < len(times) and times[begin] <= us - window_us:
                    begin += 1
                used = len(times) - begin
                if used < limit:
                    times.append(us)
                out.append((request, us, used < limit, max(limit - used - 1, 0)))
            times, begin = times[begin:], 0
            yield _frame(key[0], out, ["request_id", "us", "admitted", "remaining"])
        done = times[-1] // 1000 + window_us // 1000 + 1 if times else None
        if done is not None and state.getCurrentWatermarkMs() > done and not held.waits():
            done = None
        held.keep(times, done)

    return narrow.groupBy("tenant_id").applyInPandasWithState(
        _without_ts(step),
        f"{_types(narrow, 'tenant_id', 'request_id')}, us bigint, admitted boolean, remaining bigint",
        "waiting binary, times array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _without_ts(step):
    """The watermark needs the time column in the rows; the state does not."""
    return lambda key, batches, state: step(key, (b.drop(columns="ts") for b in batches), state)


def _frame(tenant, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    frame.insert(0, "tenant_id", tenant)
    return frame


def live_daily_quota(
    requests: DataFrame, limit: int = V.DAILY_TOKENS, watermark: str = "1 hour"
) -> DataFrame:
    """(tenant_id, request_id, us, used_before, quota_ok), in event time.

    The state of a tenant's day is its total and the requests the watermark has not
    passed; 25 hours after a day begins its total may go.
    """
    ship_package(requests.sparkSession)

    def step(key, batches, state: GroupState):
        tenant, day = key
        if tenant is None:
            return
        held = _Held(state, schema)
        held.add(batches)
        used = held.last[0] if held.last else 0
        for part in held.due():
            out = []
            for us, request, tokens in part:
                ok = used < limit
                out.append((request, us, used if ok else None, ok))
                used += tokens if ok else 0
            yield _frame(tenant, out, ["request_id", "us", "used_before", "quota_ok"]).astype(
                {"used_before": "Int64"}
            )
        expires = int(day) * 86_400_000 + 25 * 3_600_000
        spent = not held.waits() and state.getCurrentWatermarkMs() > expires
        held.keep([used], None if spent else expires)

    narrow = requests.withWatermark("ts", watermark).select(
        "tenant_id", F.unix_date(F.to_date("ts")).alias("day"), "ts", F.unix_micros("ts").alias("us"),
        "request_id", "tokens",
    )
    schema = _waiting(narrow, "us", "request_id", "tokens")
    return narrow.groupBy("tenant_id", "day").applyInPandasWithState(
        _without_ts(step),
        f"{_types(narrow, 'tenant_id', 'request_id')}, us bigint, used_before bigint, quota_ok boolean",
        "waiting binary, used array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def live_intercept(
    chunks: DataFrame, window: int = V.WINDOW_BYTES, idle_seconds: int = 60,
    watermark: str = "10 seconds", remember_seconds: int = 86_400,
) -> DataFrame:
    """What goes out of each stream, and the one row that stops it, as the chunks arrive.

    Columns: stream_id, seq (order within the stream), chunk_idx (null at the drain), event
    (forward, drain, abort, drain_abort) and payload, the bytes let through.  Chunks are
    taken in order of chunk_idx from 0; one that comes early waits in the state.  The end
    mark or `idle_seconds` without a chunk, by the watermark, drains a stream.

    Buffers are matched inside the operator, all of a trigger's in one call, so the first
    unsafe one stops its stream at once: its row carries no bytes, nothing after it is
    emitted, and later chunks are dropped unread.  The state is the last `window` bytes,
    the chunks that wait for one before them, and a mark that the stream has ended, which
    is kept for `remember_seconds`, so that a straggler does not open the stream again.
    """
    ship_package(chunks.sparkSession)
    window = window if window > 0 else V.WINDOW_BYTES

    def step(key, frames, state: GroupState):
        (stream,) = key
        if stream is None:
            return
        held, following, seq, done, places, waiting, latest = state.get if state.exists else (b"", 0, 0, False, [], [], 0)
        early = dict(zip(places, map(bytes, waiting)))
        for frame in frames:
            if frame.empty:  # a timer has no rows
                continue
            latest = max(latest, int(frame["us"].max() // 1000))
            if not done:
                for index, raw in zip(frame["chunk_idx"].tolist(), frame["raw"]):
                    if index >= following:  # what has been taken once is not taken again
                        early.setdefault(index, _bytes(raw))
        rows = []
        if not done:
            taken, following = _in_order(early, following, state.hasTimedOut)
            rows, held, done = _let_through(bytes(held), taken, window, state.hasTimedOut)
        if state.hasTimedOut and done and not rows:
            state.remove()
        else:
            if done:
                held, early = b"", {}
            state.update((held, following, seq + len(rows), done, list(early), list(early.values()), latest))
            quiet = remember_seconds if done else idle_seconds
            state.setTimeoutTimestamp(max(latest + quiet * 1000, state.getCurrentWatermarkMs() + 1))
        if rows:  # most timers send nothing
            places, events, payloads = zip(*rows)
            yield pd.DataFrame({
                "stream_id": stream, "seq": np.arange(seq, seq + len(rows)),
                "chunk_idx": pd.array(places, dtype="Int64"), "event": events, "payload": payloads,
            })

    narrow = chunks.filter(F.col("stream_id").isNotNull() | closing_row()).withWatermark("ts", watermark).select(
        "stream_id", "chunk_idx", "ts", "raw", F.unix_micros("ts").alias("us")
    )
    return narrow.groupBy("stream_id").applyInPandasWithState(
        step,
        f"{_types(narrow, 'stream_id')}, seq bigint, chunk_idx bigint, event string, payload binary",
        "held binary, following bigint, seq bigint, done boolean, "
        "places array<bigint>, waiting array<binary>, latest bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _bytes(raw) -> bytes:
    return raw.encode() if isinstance(raw, str) else bytes(raw or b"")


def _in_order(early: dict[int, bytes], following: int, final: bool) -> tuple[list[tuple[int, bytes]], int]:
    """Chunks that may be taken now, out of `early`; all of them if none will fill a gap."""
    order = sorted(early) if final else []
    while not final and following + len(order) in early:
        order.append(following + len(order))
    taken = [(index, early.pop(index)) for index in order]
    return taken, taken[-1][0] + 1 if taken else following


_END_MARK = (V.DATA_PREFIX + V.DONE).encode()


def _let_through(
    held: bytes, taken: list[tuple[int, bytes]], window: int, idle: bool
) -> tuple[list[tuple], bytes, bool]:
    """(chunk_idx, event, payload) of the chunks in order, the bytes still held, and whether
    the stream has ended: stopped, drained by its end mark, or idle."""
    ended = next((k for k, (_, raw) in enumerate(taken) if raw.rstrip(b"\r\n").endswith(_END_MARK)), None)
    if ended is not None:
        taken = taken[: ended + 1]
    drains = idle or ended is not None
    data = np.frombuffer(held + b"".join(raw for _, raw in taken), dtype=np.uint8)
    ends = len(held) + np.cumsum([len(raw) for _, raw in taken], dtype=np.int64)
    starts = np.concatenate([[len(held)], ends[:-1]]) if len(ends) else ends
    if drains:  # the last bytes are looked at once more
        starts, ends = np.append(starts, len(data)), np.append(ends, len(data))
    lows = np.maximum(starts - window, 0)
    flags = batches.unsafe_buffers(data, lows, ends, lows // max(4 * window, 1024))
    rows, whole = [], data.tobytes()
    for k, (low, end) in enumerate(zip(lows.tolist(), ends.tolist())):
        draining = k == len(taken)
        if flags[k]:
            rows.append((None if draining else taken[k][0], "drain_abort" if draining else "abort", b""))
            return rows, b"", True
        if draining:
            rows.append((None, "drain", whole[low:end]))
        else:
            rows.append((taken[k][0], "forward", whole[low : max(end - window, low)]))
    return rows, whole[max(len(whole) - window, 0) :], drains

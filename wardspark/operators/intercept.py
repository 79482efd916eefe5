"""Hold-back interception of streamed responses, replayed over a chunk table.

At each chunk the buffer holds the last `window` bytes before the chunk and the
chunk itself.  An unsafe buffer ends the stream; otherwise all but the last
`window` bytes are forwarded.  After the last chunk the held bytes are checked once
more (the drain).

Bytes are shuffled once, into runs of `run_chunks` chunks, so a long stream is many tasks
and no group is larger than a run.  Each run is matched where it lies: it is searched once,
in spans of a few buffers, for what any match must leave there, and only where something
is found are buffers cut out and matched, all of a batch in one call.  What is left is
written: offsets, times and flags, and the first and last `window` bytes.  For streams of
more than one run sums over these give each run its offset in the stream and the bytes before it, and only the buffers that
reach back into those are matched again.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions import output as O
from ..functions.slots import slot
from ..session import broadcast_if_small, ship_package, write_stage

RUN_CHUNKS = 1024


def _runs(chunks: DataFrame, window: int, run_chunks: int) -> DataFrame:
    """One written row per run: its chunks, flags as if nothing came before, first and last bytes."""
    ship_package(chunks.sparkSession)
    item = F.struct("chunk_idx", "ts", F.coalesce(F.col("raw").cast("binary"), F.lit(b"")).alias("raw"))
    known = chunks.filter(F.col("stream_id").isNotNull() & F.col("chunk_idx").isNotNull())
    runs = known.groupBy("stream_id", slot(F.col("chunk_idx"), run_chunks).alias("run")).agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )
    joined = F.array_join(F.transform("items", lambda c: c["raw"].cast("string")), "").cast("binary")
    sizes = F.transform("items", lambda c: F.octet_length(c["raw"]).cast("long"))
    scanned = runs.withColumn("scan", O.scan_runs(window)(joined, sizes))
    return write_stage(scanned.select(
        "stream_id", "run",
        F.transform("items", lambda c: c["chunk_idx"]).alias("idx"),
        F.transform("items", lambda c: c["ts"]).alias("ts"),
        "scan.*",
    ), "runs")


def _places(runs: DataFrame, window: int) -> DataFrame:
    """Of each run: the offset it begins at, its stream's bytes, and the bytes before it.

    Those are the last bytes of the run before, and of as many runs before that as begin
    within `window` bytes; runs of no bytes add nothing.
    """
    stream = Window.partitionBy("stream_id")
    based = runs.select("stream_id", "run", "n_bytes", "tail").withColumn("base", F.coalesce(
        F.sum("n_bytes").over(stream.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ))
    tail = F.when(F.col("n_bytes") > 0, F.col("tail").cast("string"))
    by_base = stream.orderBy("base")
    further = F.last(tail, ignorenulls=True).over(by_base.rangeBetween(Window.unboundedPreceding, -window - 1))
    near = F.array_join(F.collect_list(tail).over(by_base.rangeBetween(-window, -1)), "")
    before = F.concat(F.coalesce(further, F.lit("")), near).cast("binary")
    return based.select(
        "stream_id", "run", "base", F.sum("n_bytes").over(stream).alias("total"),
        (F.max("run").over(stream) == F.col("run")).alias("last"),
        F.substring(before, -window, window).alias("past"),
    )


def _placed(runs: DataFrame, window: int) -> DataFrame:
    """Runs with their places.  A stream of run 0 only has nothing before it: such runs, the
    most by far where streams are short, stay where they lie."""
    longer = broadcast_if_small(
        write_stage(runs.filter(F.col("run") != 0).select("stream_id").distinct(), "long-streams")
    )
    alone = runs.join(longer, "stream_id", "left_anti").select(
        "*", F.lit(0).cast("long").alias("base"), F.col("n_bytes").alias("total"), F.lit(True).alias("last"),
        F.lit(b"").alias("past"),
    )
    several = runs.join(longer, "stream_id", "left_semi")
    return alone.unionByName(several.join(broadcast_if_small(_places(several, window)), ["stream_id", "run"]))


def _blocks(chunks: DataFrame, window: int, run_chunks: int) -> DataFrame:
    """stream_id, block (the run), total, chunks (chunk_idx, start, end, ts, unsafe), drain_unsafe."""
    placed = _placed(_runs(chunks, window, run_chunks), window)
    finale = F.when(F.col("last"), F.substring(F.concat("past", "tail"), -window, window))
    checked = placed.withColumn("checked", O.scan_heads(window)("past", "head", "ends", "flags", finale))
    base = F.col("base")
    chunk = F.transform(
        F.arrays_zip("idx", "ends", "sizes", "ts", F.col("checked.flags").alias("unsafe")),
        lambda c: F.struct(
            c["idx"].alias("chunk_idx"), (base + c["ends"] - c["sizes"]).alias("start"),
            (base + c["ends"]).alias("end"), c["ts"].alias("ts"), c["unsafe"].alias("unsafe"),
        ),
    )
    return checked.select(
        "stream_id", F.col("run").alias("block"), "total", chunk.alias("chunks"),
        F.coalesce("checked.drain", F.lit(False)).alias("drain_unsafe"),
    )


def holdback_buffer(
    chunks: DataFrame,
    window: int = V.WINDOW_BYTES,
    run_chunks: int = RUN_CHUNKS,
) -> DataFrame:
    """Per chunk: buffer size, whether it is unsafe, bytes held and forwarded so far.

    Chunks after the first unsafe one are listed too, as if the stream went on.
    """
    window = window if window > 0 else V.WINDOW_BYTES
    scanned = _blocks(chunks, window, run_chunks).withColumn("_chunk", F.explode("chunks"))
    end, start = F.col("_chunk.end"), F.col("_chunk.start")
    return scanned.select(
        "stream_id",
        F.col("_chunk.chunk_idx").alias("chunk_idx"),
        (end - F.greatest(start - window, F.lit(0))).alias("buffer_bytes"),
        F.col("_chunk.unsafe").alias("unsafe"),
        F.least(end, F.lit(window).cast("long")).alias("held_bytes"),
        F.greatest(end - window, F.lit(0)).alias("forwarded_bytes"),
    )


def _block_verdicts(blocks: DataFrame, window: int) -> DataFrame:
    """Per block: its first unsafe chunk, the drain check, and its forwards until then."""
    found = blocks.withColumn("_first", F.get(F.filter("chunks", lambda c: c["unsafe"]), F.lit(0)))

    def forwards(c):
        reached = F.col("_first").isNull() | (c["chunk_idx"] < F.col("_first.chunk_idx"))
        return reached & (c["end"] > window) & (c["end"] > c["start"])

    return found.select(
        "stream_id",
        "block",
        "total",
        "drain_unsafe",
        F.col("_first.chunk_idx").alias("abort_chunk_idx"),
        F.col("_first.start").alias("abort_start"),
        F.size("chunks").cast("long").alias("n_chunks"),
        F.get("chunks", F.lit(0))["ts"].alias("first_ts"),
        F.element_at("chunks", -1)["ts"].alias("last_ts"),
        F.transform(F.filter("chunks", forwards), lambda c: c["ts"]).alias("forward_ts"),
    )


def _staged_verdicts(
    chunks: DataFrame, window: int, run_chunks: int
) -> DataFrame:
    """Block verdicts as a written table: one small row per block, scanned once."""
    blocks = _blocks(chunks, window, run_chunks)
    return write_stage(_block_verdicts(blocks, window), "block-verdicts")


def _stream_outcome(blocks: DataFrame, window: int) -> DataFrame:
    abort = F.min(F.when(
        F.col("abort_chunk_idx").isNotNull(),
        F.struct("abort_chunk_idx", "abort_start", "block"),
    ))
    per_stream = blocks.groupBy("stream_id").agg(
        F.sum("n_chunks").alias("n_chunks"),
        F.max("total").alias("total_bytes"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max("drain_unsafe").alias("_drain"),
        abort.alias("_abort"),
    )
    flushed = F.col("_abort").isNotNull()
    return per_stream.select(
        "stream_id",
        "n_chunks",
        "total_bytes",
        "first_ts",
        "last_ts",
        (flushed | F.col("_drain")).alias("aborted"),
        F.when(flushed, "flush").when(F.col("_drain"), "drain").alias("abort_stage"),
        F.col("_abort.abort_chunk_idx").alias("abort_chunk_idx"),
        F.when(flushed, F.greatest(F.col("_abort.abort_start") - window, F.lit(0)))
        .when(F.col("_drain"), F.greatest(F.col("total_bytes") - window, F.lit(0)))
        .otherwise(F.col("total_bytes")).alias("forwarded_bytes"),
        F.col("_abort.block").alias("_abort_block"),
    )


def stream_abort(
    chunks: DataFrame,
    window: int = V.WINDOW_BYTES,
    run_chunks: int = RUN_CHUNKS,
) -> DataFrame:
    """Per stream: aborted, at which stage and chunk, and the bytes let through."""
    window = window if window > 0 else V.WINDOW_BYTES
    blocks = _block_verdicts(_blocks(chunks, window, run_chunks), window)
    return _stream_outcome(blocks, window).drop("first_ts", "last_ts", "_abort_block")


def stream_timing(
    chunks: DataFrame,
    window: int = V.WINDOW_BYTES,
    run_chunks: int = RUN_CHUNKS,
) -> DataFrame:
    """Per stream: time to the first forwarded byte, forwards, and mean gap between them.

    The gaps of one stream add up to last minus first forward, so no ordered pass is
    needed.  A stream short enough to be held whole is first forwarded by the drain.
    """
    window = window if window > 0 else V.WINDOW_BYTES
    blocks = _staged_verdicts(chunks, window, run_chunks)
    outcome = _stream_outcome(blocks, window)
    sent = (
        blocks.join(outcome.select("stream_id", "_abort_block"), "stream_id")
        .filter(F.col("_abort_block").isNull() | (F.col("block") <= F.col("_abort_block")))
        .groupBy("stream_id")
        .agg(
            F.sum(F.size("forward_ts")).alias("n_forwards"),
            F.min(F.array_min("forward_ts")).alias("_first"),
            F.max(F.array_max("forward_ts")).alias("_last"),
        )
    )
    drained = ~F.col("aborted") & (F.col("total_bytes") > 0)
    first = F.coalesce(F.col("_first"), F.when(drained, F.col("last_ts")))
    gaps = F.greatest(F.col("n_forwards") - 1, F.lit(0))
    span = F.unix_micros("_last") - F.unix_micros("_first")
    return outcome.join(sent, "stream_id").select(
        "stream_id",
        "aborted",
        "n_chunks",
        "n_forwards",
        (F.unix_micros(first) - F.unix_micros("first_ts")).alias("ttft_us"),
        gaps.alias("n_gaps"),
        F.when(gaps > 0, span / gaps).otherwise(F.lit(0.0)).alias("avg_gap_us"),
        (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("duration_us"),
    )


def forward_gaps(
    chunks: DataFrame,
    window: int = V.WINDOW_BYTES,
    run_chunks: int = RUN_CHUNKS,
) -> DataFrame:
    """(stream_id, gap_us) for each pair of neighbouring forwards.

    Gaps inside a block are taken in its row; only the first and last forward of a
    block meet those of its neighbours.
    """
    window = window if window > 0 else V.WINDOW_BYTES
    blocks = _staged_verdicts(chunks, window, run_chunks)
    outcome = _stream_outcome(blocks, window).select("stream_id", "_abort_block")
    sent = (
        blocks.join(outcome, "stream_id")
        .filter(F.col("_abort_block").isNull() | (F.col("block") <= F.col("_abort_block")))
        .filter(F.size("forward_ts") > 0)
        .select("stream_id", "block", F.transform("forward_ts", F.unix_micros).alias("_us"))
        .withColumn("_previous", F.lag(F.element_at("_us", -1)).over(
            Window.partitionBy("stream_id").orderBy("block")))
    )
    gaps = F.transform(
        "_us",
        lambda us, i: us - F.when(i == 0, F.col("_previous")).otherwise(F.get("_us", i - 1)),
    )
    return sent.select("stream_id", F.explode(gaps).alias("gap_us")).filter(
        F.col("gap_us").isNotNull()
    )

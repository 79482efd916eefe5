"""Output patterns: personal data, secrets, unsafe instructions."""

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from . import batches
from . import fixed_values as V


@F.arrow_udf(StructType([StructField(name, BooleanType()) for name in V.OUTPUT_PATTERNS]))
def pattern_flags(texts: pa.Array) -> pa.Array:
    """One flag per output pattern, in the listed order; null for null."""
    return batches.output_flags(texts)


@F.arrow_udf(BooleanType())
def contains_unsafe(texts: pa.Array) -> pa.Array:
    """True if any output pattern matches the text exactly as given."""
    return batches.unsafe(texts)


def joined_view(raw: Column) -> Column:
    """Event bytes with framing and line ends removed: split secrets rejoin."""
    out = raw
    for part in (V.DATA_PREFIX, "\n", "\r", V.DONE):
        out = F.replace(out, F.lit(part), F.lit(""))
    return out


def spaced_view(raw: Column) -> Column:
    """Event bytes with framing removed and line ends read as blanks."""
    out = raw
    for part in (V.DATA_PREFIX, V.DONE):
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.translate(out, "\r\n", "  ")


def stream_unsafe(raw: Column) -> Column:
    """True if either view of raw event bytes holds an output pattern."""
    return contains_unsafe(joined_view(raw)) | contains_unsafe(spaced_view(raw))


_LONGS, _FLAGS = ArrayType(LongType()), ArrayType(BooleanType())


def scan_runs(window: int):
    """Column function (bytes, sizes of chunks) of a run of a stream: see batches.run_flags."""

    @F.arrow_udf(StructType([
        StructField("n_bytes", LongType()), StructField("sizes", _LONGS), StructField("ends", _LONGS),
        StructField("flags", _FLAGS), StructField("head", BinaryType()), StructField("tail", BinaryType()),
    ]))
    def scan(data: pa.Array, sizes: pa.Array) -> pa.Array:
        return batches.run_flags(data, sizes, window)

    return scan


def scan_heads(window: int):
    """Column function (past, head, ends, flags, finale): see batches.head_flags."""

    @F.arrow_udf(StructType([StructField("flags", _FLAGS), StructField("drain", BooleanType())]))
    def scan(past: pa.Array, head: pa.Array, ends: pa.Array, flags: pa.Array, finale: pa.Array) -> pa.Array:
        return batches.head_flags(past, head, ends, flags, finale, window)

    return scan

"""The five prompt signals, the risk score and the verdict."""

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import batches
from . import fixed_values as V


@F.arrow_udf(StructType([StructField(name, DoubleType()) for name in V.SIGNAL_WEIGHTS]))
def text_signals(texts: pa.Array) -> pa.Array:
    """The five unrounded signals of a text, all 0 for null.

    keyword: 0.60 per known phrase in the worst of the six forms; structural: 0.65 per role
    override there; repetition: density of override verbs there, with a floor for texts
    spelled out in letters; boundary: 0.50 per chat-format marker in the text as sent;
    entropy: how far the character entropy lies above 5 bits.  None is above 1.
    """
    return batches.signals(texts)


def round2(value: Column) -> Column:
    """Two decimals, half away from zero, on the binary value."""
    return F.round(value * F.lit(100.0)) / F.lit(100.0)


def risk_score(signals: dict[str, Column], weights: dict[str, float] = V.SIGNAL_WEIGHTS) -> Column:
    """Weighted mean of the unrounded signals, rounded to two decimals."""
    total, weight_sum = F.lit(0.0), 0.0
    for name, weight in weights.items():
        total = total + signals[name] * F.lit(weight)
        weight_sum += weight
    return round2(total / F.lit(weight_sum) if weight_sum > 0 else total)


def verdict(score: Column, block: float = V.BLOCK_THRESHOLD, tag: float = V.TAG_THRESHOLD) -> Column:
    return F.when(score >= block, "block").when(score >= tag, "tag").otherwise("pass")

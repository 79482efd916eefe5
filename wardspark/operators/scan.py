"""Prompt and response scanning over tables of text."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions import output as O
from ..functions import signals as S
from ..session import ship_package

SIGNAL_NAMES = tuple(V.SIGNAL_WEIGHTS)


def with_signals(df: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """Add the five unrounded signal columns; `keep` names the other columns.

    Texts go through RE2 automata where they are read, in Arrow batches; nothing shuffles.
    """
    keep = keep if keep is not None else df.columns
    ship_package(df.sparkSession)
    scanned = df.select(*keep, S.text_signals(text_col).alias("_signals"))
    return scanned.select(*keep, *[F.col("_signals")[name].alias(name) for name in SIGNAL_NAMES])


def input_scan(
    df: DataFrame,
    text_col: str,
    keep: list[str] | None = None,
    block: float = V.BLOCK_THRESHOLD,
    tag: float = V.TAG_THRESHOLD,
    weights: dict[str, float] = V.SIGNAL_WEIGHTS,
) -> DataFrame:
    """Score and verdict per text, with the rounded signals flat and as a map."""
    keep = keep if keep is not None else df.columns
    return with_scores(with_signals(df, text_col, keep), keep, block, tag, weights)


def with_scores(
    signalled: DataFrame, keep: list[str], block: float = V.BLOCK_THRESHOLD, tag: float = V.TAG_THRESHOLD,
    weights: dict[str, float] = V.SIGNAL_WEIGHTS,
) -> DataFrame:
    """Score, verdict and rounded signals from the unrounded ones."""
    unrounded = {name: F.col(name) for name in SIGNAL_NAMES}
    scored = signalled.withColumn("score", S.risk_score(unrounded, weights))
    rounded = {name: S.round2(F.col(name)) for name in SIGNAL_NAMES}
    return scored.select(
        *keep,
        "score",
        S.verdict(F.col("score"), block, tag).alias("verdict"),
        *[rounded[name].alias(name) for name in SIGNAL_NAMES],
        F.map_from_arrays(
            F.array(*[F.lit(name) for name in SIGNAL_NAMES]),
            F.array(*[rounded[name] for name in SIGNAL_NAMES]),
        ).alias("signals"),
    )


def output_scan(df: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """One flag per output pattern and `unsafe` if any is set."""
    keep = keep if keep is not None else df.columns
    ship_package(df.sparkSession)
    flagged = df.select(*keep, O.pattern_flags(text_col).alias("_flags"))
    names = list(V.OUTPUT_PATTERNS)
    return flagged.select(*keep, *[F.col("_flags")[name].alias(name) for name in names]).withColumn(
        "unsafe", _any(names)
    )


def output_scan_views(df: DataFrame, raw_col: str, keep: list[str] | None = None) -> DataFrame:
    """`joined_unsafe`, `spaced_unsafe` and `unsafe` over raw event bytes."""
    keep = keep if keep is not None else df.columns
    ship_package(df.sparkSession)
    raw = F.col(raw_col)
    return df.select(
        *keep,
        O.contains_unsafe(O.joined_view(raw)).alias("joined_unsafe"),
        O.contains_unsafe(O.spaced_view(raw)).alias("spaced_unsafe"),
    ).withColumn("unsafe", F.col("joined_unsafe") | F.col("spaced_unsafe"))


def verdict_summary(scanned: DataFrame, by: list[str]) -> DataFrame:
    """Counts by verdict and score statistics per group."""
    return scanned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(F.col("verdict") == name).alias(f"n_{name}")
            for name in ("pass", "tag", "block")
        ],
        mean_score().alias("mean_score"),
        F.max("score").alias("max_score"),
    )


def mean_score() -> Column:
    """Mean of two-decimal scores by whole hundredths, so row order cannot change it."""
    hundredths = F.sum(F.round(F.col("score") * 100).cast("long"))
    return hundredths / (F.count("score") * F.lit(100.0))


def pattern_counts(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Texts per group that set each output flag, in one pass."""
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(name)).alias(f"n_{name}") for name in V.OUTPUT_PATTERNS],
        F.count_if(F.col("unsafe")).alias("n_unsafe"),
    )


def corpus_scan(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Input score and output flags of each text; both scans share one pass of batches."""
    ship_package(df.sparkSession)
    staged = df.select(*keep, S.text_signals(text_col).alias("_signals"), O.pattern_flags(text_col).alias("_flags"))
    flags = list(V.OUTPUT_PATTERNS)
    scored = with_scores(staged.select(
        *keep, *[F.col("_flags")[name].alias(name) for name in flags],
        *[F.col("_signals")[name].alias(name) for name in SIGNAL_NAMES],
    ), [*keep, *flags])
    return scored.drop("signals").withColumn("unsafe", _any(flags))


def _any(names: list[str]) -> Column:
    result = F.col(names[0])
    for name in names[1:]:
        result = result | F.col(name)
    return result

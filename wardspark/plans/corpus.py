"""Corpus audit: every text scored as a prompt and searched as a response."""

from pyspark.sql import DataFrame, functions as F

from ..operators import scan


def corpus_report(documents: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    """Verdict counts, scores and unsafe texts per group, in one pass over the corpus."""
    scanned = scan.corpus_scan(documents, text_col, by)
    return scanned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "block").alias("n_block"),
        F.count_if(F.col("verdict") == "tag").alias("n_tag"),
        F.count_if("unsafe").alias("n_unsafe"),
        scan.mean_score().alias("mean_score"),
        F.max("score").alias("max_score"),
    )

"""Operator 13: what a chain of filters removes, in every order and for every part.

Each document is reduced to a mask of the filters that it fails, and the documents to one
cell of counts per part and mask.  A walk over all subsets of filters in Gray-code order
toggles one filter at a time: every mask cell counts its active failures, and a cell that
gains its first or loses its last one leaves or joins the running survivors.  The
survivors of all subsets (32 for five filters) are kept; a step of an order is the
difference between the states before and after it, so no order reads documents again.

Only keys and hashes move, never texts.  Equal texts are found by groups of their hash, which are
added up before they are shuffled and again per document, so a text with any number of
copies stays a few rows.  A part has at most one row per mask when Python sees it.

Null text is the empty text, null lang the part "".  A null doc_id is smaller than none,
and no doc_id is smaller than it.  Repeated rows are counted one by one and are not each
other's copies, as their doc_id is the same; ties of the smallest doc_id pass.  A document
with several labels has each mark that any of them sets.  An empty table has no parts, so
no rows.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship_package

WHITE_SPACE = "\t\n\x0b\x0c\r"
COPY = "E"
MARKS = ("n", "good", "toxic")


def split_words(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks."""
    blanked = F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.array_remove(F.split(blanked, " ", -1), "")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that read nothing but the text, by the filters' letters."""
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    count = F.size(words).cast("long")
    return {
        "A": count < 100,
        "B": F.size(F.array_distinct(words)) * F.lit(100) < count * 80,
        "C": capitals * 100 > F.char_length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails filter k), n, good, toxic; one row per part and mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    split = docs.select(
        F.col("doc_id").alias("id"), part.alias("part"), text.alias("body"), split_words(text).alias("tokens")
    )
    failed = text_filters(F.col("body"), F.col("tokens")).values()
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))
    rows = split.select("id", "part", F.unhex(F.sha2("body", 256)).alias("hash"), mask.alias("mask"))
    marked = _with_marks(rows.groupBy("hash", "part", "mask", "id").agg(F.count("*").alias("n")), labels)

    # Of a text's documents only those with its least id pass the copy filter.
    alike = marked.groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("at_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("hash"))
    passing = F.col("nameless") + F.when(first, F.col("at_least")).otherwise(0)
    sides = alike.withColumn("passing", passing).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct((F.col("mask") + (1 << len(failed))).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
        )).alias("side"),
    )
    n = F.col("side.n")
    return sides.where(n > 0).groupBy("part", F.col("side.mask").alias("mask")).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )


def _with_marks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the marks of `labels`.  Rows without an id match none; a number of their own
    keeps them from meeting in one task."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    ).withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    joined = rows.withColumn("spread", spread).join(marks, ["id", "spread"], "left").drop("spread")
    return joined.fillna(False, ["good", "toxic"])


def gray_walk(cells: dict[int, np.ndarray], filters: int) -> np.ndarray:
    """Survivors of every subset of filters, by the subset's bits; one row of counts each."""
    running = sum(cells.values())
    failing = dict.fromkeys(cells, 0)
    states = np.empty((1 << filters, len(running)), dtype=np.int64)
    states[0], active = running, 0
    for step in range(1, 1 << filters):
        toggled = step & -step  # consecutive Gray codes differ in this bit
        active ^= toggled
        on = bool(active & toggled)
        for mask, counts in cells.items():
            if mask & toggled:
                failing[mask] += 1 if on else -1
                if failing[mask] == int(on):  # its first failure, or none left
                    running = running - counts if on else running + counts
        states[active] = running
    return states


def order_steps(cells: dict[int, np.ndarray], names: Sequence[str]) -> Iterator[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley for all orders of the filters."""
    states = gray_walk(cells, len(names))
    bit = {name: 1 << k for k, name in enumerate(names)}
    whole = len(states) - 1
    fails = {name: states[0][0] - states[b][0] for name, b in bit.items()}
    only = {name: states[whole ^ b][0] - states[whole][0] for name, b in bit.items()}
    removed_by = dict.fromkeys(names, 0)
    rows = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            lost = states[before] - states[before | bit[name]]
            before |= bit[name]
            removed_by[name] += lost[0]
            rows.append((name, "".join(order), step, states[before][0], lost))
    for name, order, step, kept, lost in rows:
        yield (order, step, kept, lost[0], fails[name] - lost[0], only[name], lost[1], lost[2], removed_by[name])


COLUMNS = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_orders(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the named filters and step, from cells of counts."""
    ship_package(cells.sparkSession)
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS[2:])

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(group["mask"].tolist(), group[list(MARKS)].to_numpy(dtype=np.int64)))
        found = pd.DataFrame(list(order_steps(counts, names)), columns=COLUMNS)
        found.insert(0, "part", group["part"].iloc[0])
        return found

    return cells.groupBy("part").applyInPandas(steps, schema)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the four text filters and the copy filter over whole documents."""
    return audit_orders(failure_cells(docs, labels), ("A", "B", "C", "D", COPY))

"""Operator 1: passages of benchmark items in documents, by SimHash of item-sized windows.

1. Windows.  An item of n shingles is similar (weighted Jaccard of at least s) to a window
   of as many words only if at most (1-2s/(1+s))n of its shingles are missing, and to a
   whole text of fewer words only if at most (1-s)n are.  Its floor((1-s)n)+1 rarest
   shingles are looked up in every document, and each window of the item's size is laid
   that holds as many of them as must be there, in whatever order.  No other can pass.
2. SimHash of each window and item over 64 bits, each shingle weighted by its count.
3. Multi-index Hamming blocks.  The bits are cut into RADIUS+1 blocks; two fingerprints
   within RADIUS agree on a whole block, so a join on (size, block, value) finds all.
4. The exact weighted similarity of window and item decides.

All steps are joins, groupings and column functions.  Work is done per distinct text, so
copies cost no more than their first pass, and only texts with a lookup hit are read again.
Items without words are never found; an item shorter than a shingle is looked up as one run
of its own words.  Null and empty texts hold nothing; repeated items are told by
`item_id` and words, repeated documents give equal rows; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SHINGLE_WORDS, SIMILARITY, bounded_broadcast, shingles, stage, word_hashes

RADIUS = 19
BITS = 64
TEXT_KEY = ["k1", "k2"]
WINDOW = [*TEXT_KEY, "words", "start"]


def text_key(text: Column) -> list[Column]:
    """96 bits that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.crc32(text).alias("k2")]


def item_table(benchmark: DataFrame) -> DataFrame:
    """item, words, its shingles in order; staged, as three steps read it."""
    hashed = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    return stage(
        hashed.select("item_id", F.size("h").alias("words"), shingles(F.col("h")).alias("shingles"))
        .distinct().withColumn("item", F.monotonically_increasing_id()),
        "items",
    )


def lookup_table(items: DataFrame, similarity: float) -> DataFrame:
    """shingle -> (item, words, need): the rarest shingles of each item.

    `need` tells how many of them a window of the item's size must hold.
    """
    n = F.size("shingles")
    one = items.select("item", "words", n.alias("n"), F.explode("shingles").alias("shingle")).distinct()
    spread = one.groupBy("shingle").agg(F.count("*").alias("items"))
    by_item = Window.partitionBy("item")
    ranked = one.join(spread, "shingle").withColumn(
        "rank", F.row_number().over(by_item.orderBy("items", "shingle"))
    )
    missing = F.floor(F.col("n") * (1 - similarity) + 1e-9)
    absent = F.floor(F.col("n") * (1 - 2 * similarity / (1 + similarity)) + 1e-9)
    chosen = ranked.where(F.col("rank") <= missing + 1)
    need = F.greatest(F.lit(1), F.count("*").over(by_item) - absent).cast("int")
    return chosen.select("shingle", "item", "words", need.alias("need"))


def lay_windows(docs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Windows (text key, words, start) with enough looked-up shingles of one item, each once."""
    hashed = docs.select(*text_key(F.col("text")), word_hashes(F.col("text")).alias("h")).where(
        F.size("h") > 0
    )

    def places(size: int) -> DataFrame:
        return hashed.select(
            *TEXT_KEY, F.size("h").alias("length"), F.posexplode(shingles(F.col("h"), size)).alias("at", "shingle")
        )

    long = lookup.where(F.col("words") >= SHINGLE_WORDS)
    hits = places(SHINGLE_WORDS).join(bounded_broadcast(long), "shingle")
    # a window of fewer words than the item is the whole text, which may lack more shingles
    hits = hits.withColumn("need", F.when(F.col("length") < F.col("words"), 1).otherwise(F.col("need")))
    group = [*TEXT_KEY, "length", "item", "words", "need"]
    several = hits.groupBy(*group).agg(
        F.collect_list(F.struct("at", "shingle")).alias("found"), F.collect_set("shingle").alias("kinds")
    ).where(F.size("kinds") >= F.col("need"))
    each = several.select(*group, F.inline("found"))
    last = F.greatest(F.lit(0), F.col("length") - F.col("words"))
    starts = F.sequence(
        F.least(last, F.greatest(F.lit(0), F.col("at") - F.col("words") + SHINGLE_WORDS)), F.least(last, F.col("at"))
    )
    counted = each.select(*group, "shingle", F.explode(starts).alias("start")).groupBy(*group, "start").agg(
        F.collect_set("shingle").alias("kinds")
    )
    windows = counted.where(F.size("kinds") >= F.col("need")).select(*TEXT_KEY, "words", "start")
    for row in lookup.where(F.col("words") < SHINGLE_WORDS).select("words").distinct().collect():
        short = bounded_broadcast(lookup.where(F.col("words") == row.words).select("shingle", "words"))
        whole = places(row.words).where(F.col("length") >= row.words).join(short, "shingle")
        windows = windows.union(whole.select(*TEXT_KEY, "words", F.col("at").alias("start")))
    return windows.distinct()


def window_shingles(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with the array of their shingles; only their texts are read again."""
    keys = windows.select(*TEXT_KEY).distinct()
    keyed = docs.where(F.col("text").isNotNull()).select(*text_key(F.col("text")), "text")
    texts = (
        keyed.join(bounded_broadcast(keys), TEXT_KEY, "left_semi")
        .groupBy(*TEXT_KEY).agg(F.first("text").alias("text"))
        .select(*TEXT_KEY, word_hashes(F.col("text")).alias("h"))
    )
    cut = windows.join(texts, TEXT_KEY).select(
        *WINDOW, F.slice("h", F.col("start") + 1, F.col("words")).alias("h")
    )
    return cut.select(*WINDOW, shingles(F.col("h")).alias("shingles"))


def simhash(sets: DataFrame, key: list[str]) -> DataFrame:
    """key, fingerprint: bit b is set if most shingles, by weight, have it set.

    Counters of two bits share a long: bits k and k+32 of a shingle are added at once.
    """
    lanes = F.lit((1 << 32) + 1)
    each = sets.select(*key, F.explode("shingles").alias("s"))
    sums = each.groupBy(*key).agg(
        F.count("*").alias("n"),
        *[F.sum(F.shiftrightunsigned("s", k).bitwiseAND(lanes)).alias(f"b{k}") for k in range(32)],
    )
    value = F.lit(0).cast("long")
    for b in range(BITS):
        lane = f"b{b % 32}"
        half = F.shiftrightunsigned(lane, 32) if b >= 32 else F.col(lane).bitwiseAND(F.lit((1 << 32) - 1))
        bit = (1 << b) if b < 63 else -(1 << 63)
        value = value.bitwiseOR(F.when(2 * half > F.col("n"), F.lit(bit).cast("long")).otherwise(F.lit(0)))
    return sums.select(*key, value.alias("fingerprint"))


def blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and mask of radius+1 blocks that cover all bits."""
    cuts = [BITS * j // (radius + 1) for j in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _block_values(fingerprint: Column, radius: int) -> Column:
    return F.array(*[
        F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit(mask).cast("long"))
        for a, mask in blocks(radius)
    ])


def within_radius(left: DataFrame, right: DataFrame, same: str, radius: int = RADIUS) -> DataFrame:
    """All pairs of rows with equal `same` whose fingerprints differ in at most `radius` bits.

    left(..., same, fingerprint), right(..., same, other).  A pair that agrees on several
    blocks is kept at the first of them.
    """
    a = left.select("*", F.posexplode(_block_values(F.col("fingerprint"), radius)).alias("block", "value"))
    b = right.select("*", F.posexplode(_block_values(F.col("other"), radius)).alias("block", "value"))
    differ = F.col("fingerprint").bitwiseXOR(F.col("other"))
    earlier = F.lit(False)
    for j, (bit, mask) in enumerate(blocks(radius)):
        agree = F.shiftrightunsigned(differ, bit).bitwiseAND(F.lit(mask).cast("long")) == 0
        earlier = earlier | ((F.col("block") > j) & agree)
    # a row of `right` becomes radius+1 rows, which the size estimate does not know
    pairs = a.join(bounded_broadcast(b, (8 << 20) // (radius + 1)), [same, "block", "value"])
    near = pairs.withColumn("distance", F.bit_count(differ)).where((F.col("distance") <= radius) & ~earlier)
    return near.drop("block", "value")


def weighted_similarity(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Exact weighted Jaccard of pairs(window..., shingles, item, distance)."""
    key = [*WINDOW, "item", "distance"]
    ours = pairs.select(*key, F.size("shingles").alias("n"), F.explode("shingles").alias("s")).groupBy(
        *key, "n", "s"
    ).agg(F.count("*").alias("c"))
    theirs = items.select("item", F.size("shingles").alias("other_n"), F.explode("shingles").alias("s")).groupBy(
        "item", "other_n", "s"
    ).agg(F.count("*").alias("other_c"))
    shared = ours.join(theirs, ["item", "s"]).groupBy(*key, "n", "other_n").agg(
        F.sum(F.least("c", "other_c")).alias("shared")
    )
    return shared.select(
        *key, (F.col("shared") / (F.col("n") + F.col("other_n") - F.col("shared"))).alias("similarity")
    )


def find_passages(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """Text key, item_id and the best window of each text that holds an item."""
    items = item_table(benchmark)
    lookup = stage(lookup_table(items, similarity), "lookup")
    windows = stage(lay_windows(docs, lookup), "windows")
    cut = stage(window_shingles(docs, windows), "window-shingles")
    prints = simhash(cut, WINDOW)
    item_prints = simhash(items, ["item", "words"]).withColumnRenamed("fingerprint", "other")
    near = within_radius(prints, stage(item_prints, "item-prints"), "words", radius)
    pairs = near.select(*WINDOW, "item", "distance").join(cut, WINDOW)
    exact = weighted_similarity(pairs, items).where(F.col("similarity") >= similarity - 1e-9)
    best = F.max_by(
        F.struct("start", "words", "distance", "similarity"),
        F.struct("similarity", -F.col("distance"), -F.col("start")),
    )
    found = exact.join(bounded_broadcast(items.select("item", "item_id")), "item")
    return found.groupBy(*TEXT_KEY, "item_id").agg(best.alias("w")).select(*TEXT_KEY, "item_id", "w.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per document and item it holds, with place, distance and similarity."""
    found = stage(find_passages(docs, benchmark, **settings), "passages")
    keyed = docs.select("doc_id", *text_key(F.col("text")))
    return keyed.join(bounded_broadcast(found), TEXT_KEY).select(
        "doc_id", "item_id", F.col("start").alias("start_word"), F.col("words").alias("n_words"),
        "distance", "similarity",
    )


def without_passages(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    found = stage(find_passages(docs, benchmark, **settings), "passages")
    first, second = text_key(docs["text"])
    keys = bounded_broadcast(found.select("k1", "k2").distinct())
    return docs.join(keys, (first == keys["k1"]) & (second == keys["k2"]), "left_anti")

"""Operator 2: threshold-scaled sketches of documents.

The sketch of a text keeps every shingle hash below a fixed fraction of the hash range,
and at least the `LEAST` smallest, so that short texts are not left bare.  Sketches of
parts merge by union, and two sketches of very unequal texts still estimate how much of
one is contained in the other, because both are complete up to a known hash.  Words are
counted in lower case without punctuation; a text without words is one shingle, itself.

All of it is column functions.  Each text is shuffled once, to meet its successor: ids are
cut into ranges of about `RANGE_BYTES`, and the first document of each range goes to the
range before as well.  Null text counts as empty.  Order is by doc_id, nulls first, then
text; repeated rows follow each other; a single document follows itself; an empty table
gives no rows.  Ranges are cut between ids, so all rows of one id lie in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shingles, splits_for, word_hashes

FRACTION = 8
LEAST = 32
LOWEST, HIGHEST = -(1 << 31), (1 << 31) - 1
THRESHOLD = LOWEST + (1 << 32) // FRACTION
RANGE_BYTES = 16 << 20
MAX_RANGES = 1 << 16


def with_sketch(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sketch of a text column: an ascending array of 32-bit hashes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.withColumn("_hashes", word_hashes(whole))
    run = F.when(F.size("_hashes") > 0, shingles(F.col("_hashes"))).otherwise(F.array(F.xxhash64(whole)))
    small = F.transform(run, lambda h: F.shiftright(h, 32).cast("int"))
    kept = (
        hashed.withColumn("_all", small).drop("_hashes")
        .withColumn("_below", F.array_distinct(F.filter("_all", lambda h: h < THRESHOLD)))
    )
    least = F.slice(F.array_sort(F.array_distinct("_all")), 1, LEAST)
    return kept.withColumn(
        name, F.when(F.size("_below") >= LEAST, F.array_sort("_below")).otherwise(least)
    ).drop("_all", "_below")


def merge(left: Column, right: Column) -> Column:
    """Sketch of two parts together, by the same rule; parts' own shingles only."""
    both = F.array_sort(F.array_union(left, right))
    kept = F.filter(both, lambda h: h <= F.least(complete_to(left), complete_to(right)))
    below = F.filter(kept, lambda h: h < THRESHOLD)
    return F.when(F.size(below) >= LEAST, below).otherwise(F.slice(kept, 1, LEAST))


def complete_to(sketch: Column) -> Column:
    """Up to this hash a sketch holds all there are."""
    return F.when(F.size(sketch) < LEAST, F.lit(HIGHEST)).otherwise(
        F.greatest(F.lit(THRESHOLD - 1), F.array_max(sketch))
    )


def compare(left: Column, right: Column) -> Column:
    """struct(likeness, contained): Jaccard estimate, and the share of left in right."""
    limit = F.least(complete_to(left), complete_to(right))
    return F.transform(
        F.array(limit),
        lambda top: F.transform(
            F.array(F.struct(
                F.filter(left, lambda h: h <= top).alias("a"), F.filter(right, lambda h: h <= top).alias("b")
            )),
            lambda p: F.transform(
                F.array(F.size(F.array_intersect(p["a"], p["b"]))),
                lambda n: F.struct(
                    (n / F.greatest(F.size(p["a"]) + F.size(p["b"]) - n, F.lit(1))).alias("likeness"),
                    (n / F.greatest(F.size(p["a"]), F.lit(1))).alias("contained"),
                ),
            )[0],
        )[0],
    )[0]


def fingerprint(sketch: Column) -> Column:
    """Eight hexadecimal digits per hash, ascending as unsigned numbers."""
    digits = F.transform(
        sketch, lambda h: F.lpad(F.lower(F.hex(h.cast("long") - LOWEST)), 8, "0")
    )
    return F.array_join(digits, "")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key, by two short searches."""
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not groups:
        return F.lit(0)
    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    group = F.size(F.filter(firsts, lambda b: b <= key))
    inside = F.size(F.filter(F.get(table, group - 1), lambda b: b <= key))
    return F.when(key.isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * width + inside)


def with_next(docs: DataFrame, columns: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) with `next_<column>` of the document that follows."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    total, rows, nulls = docs.agg(
        F.coalesce(F.sum(size), F.lit(0)), F.count("*"), F.count_if(F.col("doc_id").isNull())
    ).first()
    if not rows:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    ranges = min(MAX_RANGES, max(4 * splits_for(docs), -(-total // range_bytes)))
    steps = [i / ranges for i in range(1, ranges)]
    cuts, least = docs.agg(
        F.percentile_approx("doc_id", steps, max(10_000, 20 * ranges)), F.min("doc_id")
    ).first()
    bounds = sorted(set(cuts or []))
    last = len(bounds)
    own = _range_of(F.col("doc_id"), bounds)
    opens = (own > 0) & (F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), own - 1) == F.col("doc_id")) if bounds else F.lit(False)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    here, before, round_trip = (
        F.struct(F.lit(place).alias("at") if isinstance(place, int) else place.alias("at"), F.lit(copy).alias("copy"))
        for place, copy in ((own, 0), (own - 1, 1), (last, 2))
    )
    places = F.filter(
        F.array(
            here, F.when(F.coalesce(opens, F.lit(False)), before),
            F.when(F.coalesce(first, F.lit(False)), round_trip),
        ),
        lambda p: p.isNotNull(),
    )
    spread = docs.withColumn("_place", F.explode(places)).select(
        *docs.columns, F.col("_place.at").alias("_at"), F.col("_place.copy").alias("_copy")
    )
    order = Window.partitionBy("_at").orderBy(
        F.col("_copy") == 2, F.col("doc_id").asc_nulls_first(), "text"
    )
    ahead = spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return ahead.where("_copy = 0").drop("_at", "_copy")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Sketches of each text and of its edited form, and how they compare."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ahead = with_next(with_sketch(texts, "text", "sketch"), ["text", "sketch"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = ahead.withColumns({"n_chars": n.cast("long"), "_quarter": quarter}).withColumn(
        "edited",
        F.concat(
            F.expr("left(text, cast(n_chars - _quarter as int))"), F.expr("left(next_text, _quarter)")
        ),
    )
    sketched = with_sketch(edited.drop("text", "next_text", "_quarter"), "edited", "edited_sketch")
    compared = sketched.withColumns({
        "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256),
        "_edited": compare(F.col("sketch"), F.col("edited_sketch")),
        "_next": compare(F.col("sketch"), F.col("next_sketch")),
    })
    return compared.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("_edited.likeness").alias("near_edited"), F.col("_next.likeness").alias("near_next"),
        F.col("_edited.contained").alias("edited_holds"), F.col("_next.contained").alias("next_holds"),
    )

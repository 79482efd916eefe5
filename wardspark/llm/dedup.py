"""Operator 3: near-duplicate classes by DartMinHash signatures and banded joining.

A text is a weighted set: its shingles with their counts.  Every unit of weight of every
shingle has its own fixed stream of darts, spread over time at unit rate; each dart names
a coordinate.  A text keeps, per coordinate, the earliest dart that falls in its regions,
so two texts agree on a coordinate with the odds of their weighted Jaccard similarity.
About k ln k + 2k darts fill all k coordinates, whatever the text's length; a text with an
empty coordinate looks on for twice as long.

Equal texts are one node.  Nodes that agree on a whole band meet in a bucket.  No bucket
is expanded into pairs.  First all its members are compared exactly with one of them, the
star: the most central one, which meets the most others over all its buckets.  Then, only
in buckets whose members are still in different classes, those outside the bucket's main
class are compared with `STARS` more central members.  What is still apart is settled by
an exact filter: two texts that are alike share one of their rarest shingles, so outsiders
are joined with the members of such buckets on these, and only pairs that meet again are
compared.  A text with many shingles of its own meets nobody there, however many members
its bucket has.  So all pairs that meet in a bucket are either in one class or proven
unlike, and classes are those of all pairs.

The result is one row per document: `class_id` is the least doc_id of the class.  Texts
without words are in a class only with equal texts.  Null text counts as empty.  Documents
without id belong to classes like others; a class of such alone has a null id.  Repeated
rows are in one class.  An empty table gives no rows.  At a similarity of exactly 0.8 a
pair fails to meet with odds of 3 in a million, above that with less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import ship_package
from .common import (
    SHINGLE_WORDS, SIMILARITY, batch_words, bounded_broadcast, mix, slices, stage, text_shingles,
)

BANDS, ROWS = 24, 4
STARS = 8
SALT_MEMBERS = 64

_LAYER = np.uint64(0xA24BAED4963EE407)
_DART = 0x9FB21C651E98DF25
_PLACE = np.uint64(0xD1B54A32D192ED03)


def node_of(text="text"):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def weight_units(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' units of weight: an id per shingle and repetition, and the text it is in."""
    count = np.diff(firsts)
    full = np.maximum(count - SHINGLE_WORDS + 1, 0)
    owner = np.repeat(np.arange(len(count)), full)
    units = np.zeros(0, dtype=np.uint64)
    if len(owner):  # shingles that cross from one text into the next are left out
        skipped = firsts[:-1] - np.append(0, np.cumsum(full)[:-1])
        units = text_shingles(hashes)[np.arange(len(owner)) + np.repeat(skipped, full)]
    short = np.flatnonzero((count > 0) & (count < SHINGLE_WORDS))
    if len(short):
        extra = np.concatenate([text_shingles(hashes[firsts[i] : firsts[i + 1]]) for i in short])
        units, owner = np.concatenate([units, extra]), np.concatenate([owner, short])
    order = np.lexsort((units, owner))
    units, owner = units[order], owner[order]
    same = np.zeros(len(units), dtype=bool)
    same[1:] = (units[1:] == units[:-1]) & (owner[1:] == owner[:-1])
    place = np.arange(len(units))
    layer = place - np.maximum.accumulate(np.where(same, 0, place))
    return np.where(same, mix(units + layer.astype(np.uint64) * _LAYER), units), owner


def throw_darts(
    units: np.ndarray, owner: np.ndarray, until: np.ndarray, coordinates: int,
    out: np.ndarray, best: np.ndarray,
) -> None:
    """Earliest dart per text and coordinate, of all darts before each text's `until`."""
    time = np.zeros(len(units))
    number = 0
    while len(units):
        number += 1
        dart = mix(units + np.uint64(number * _DART % (1 << 64)))
        time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
        alive = time < until[owner]
        units, owner, time, dart = units[alive], owner[alive], time[alive], dart[alive]
        value = mix(dart ^ _PLACE)
        slot = owner * coordinates + (value % np.uint64(coordinates)).astype(np.int64)
        np.minimum.at(best, slot, time)
        first = best[slot] == time
        out[slot[first]] = value[first]


def signatures(texts: list[str], coordinates: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A row of coordinates per text, and which texts have words."""
    hashes, firsts = batch_words(texts)
    units, owner = weight_units(hashes, firsts)
    weight = np.bincount(owner, minlength=len(texts)).astype(np.float64)
    out = np.zeros(len(texts) * coordinates, dtype=np.uint64)
    best = np.full(len(texts) * coordinates, np.inf)
    until = (coordinates * np.log(coordinates) + 2 * coordinates) / np.maximum(weight, 1)
    throw_darts(units, owner, until, coordinates, out, best)
    while True:
        bare = np.isinf(best).reshape(len(texts), coordinates).any(axis=1) & (weight > 0)
        if not bare.any():
            return out.reshape(len(texts), coordinates), weight > 0
        until = until * 2
        again = bare[owner]
        throw_darts(units[again], owner[again], until, coordinates, out, best)


def band_keys(rows: np.ndarray, bands: int = BANDS) -> np.ndarray:
    keys = np.zeros((len(rows), bands), dtype=np.uint64)
    depth = rows.shape[1] // bands
    for band in range(bands):
        key = np.full(len(rows), band + 1, dtype=np.uint64)
        for k in range(depth):
            key = mix(key * _LAYER + rows[:, band * depth + k])
        keys[:, band] = key
    return keys.view(np.int64)


def with_bands(docs: DataFrame) -> DataFrame:
    """doc_id, node, and the keys of the text's bands (none for texts without words)."""
    ship_package(docs.sparkSession)

    def bands(parts):
        for batch in slices(parts):
            rows, wordy = signatures(batch.column("text").to_pylist())
            keys = [k if w else [] for k, w in zip(band_keys(rows), wordy)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "node", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = docs.select("doc_id", node_of().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(bands, f"doc_id {kind}, node binary, keys array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def _weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    hashes, _ = batch_words([text])
    return np.unique(text_shingles(hashes), return_counts=True)


def verify(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(node, star) whose texts are at least `similarity` alike, exactly.

    Only texts that are in a pair move, once per star.  A star that many meet is salted:
    it is sent once to every `SALT_MEMBERS` of them.
    """
    crowd = stage(
        pairs.groupBy("star").agg(F.ceil(F.count("*") / SALT_MEMBERS).cast("int").alias("salts")), "stars"
    )
    nodes = pairs.select("node").union(crowd.select(F.col("star").alias("node"))).distinct()
    texts = stage(
        docs.select(node_of().alias("node"), "text")
        .join(bounded_broadcast(stage(nodes, "paired")), "node", "left_semi")
        .groupBy("node").agg(F.first("text").alias("text")),
        "paired-texts",
    )
    members = (
        pairs.join(bounded_broadcast(crowd), "star")
        .withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
        .join(texts, "node")
    )
    stars = (
        texts.select(F.col("node").alias("star"), F.col("text").alias("star_text"))
        .join(bounded_broadcast(crowd), "star")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    )
    both = members.join(stars.hint("merge"), ["star", "salt"]).select("node", "star", "text", "star_text")

    def compare(parts):
        last, held = None, None
        for batch in slices(parts):
            alike = []
            stars_, texts_ = batch.column("star"), batch.column("text")
            star_texts = batch.column("star_text")
            for i in range(batch.num_rows):
                star = stars_[i].as_py()
                if star != last:
                    last, held = star, _weights(star_texts[i].as_py())
                alike.append(weighted_jaccard(_weights(texts_[i].as_py()), held) >= similarity - 1e-9)
            yield batch.select(["node", "star"]).filter(pa.array(alike, pa.bool_()))

    return both.mapInArrow(compare, "node binary, star binary")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, label: the least node of each connected component, for all nodes with a link.

    Least labels spread along links and, by following labels of labels, at doubling speed.
    """
    one = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stage(one.union(one.select("other", "node")).distinct(), "links")
    labels = stage(
        both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")),
        "labels",
    )
    while True:
        small = bounded_broadcast(labels)  # one exchange a round then, three beyond
        around = both.join(small.select(F.col("node").alias("other"), "label"), "other").select("node", "label")
        near = (
            labels.select("node", "label", F.col("label").alias("own"))
            .union(around.withColumn("own", F.lit(None).cast("binary")))
            .groupBy("node").agg(F.min("label").alias("near"), F.max("own").alias("own"))
        )
        hop = small.select(F.col("node").alias("near"), F.col("label").alias("far"))
        label = F.least("near", "far")
        moved = stage(
            near.join(hop, "near").select("node", label.alias("label"), (label < F.col("own")).alias("moved")),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def with_units(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, size, unit: every unit of weight of the given nodes' texts."""
    texts = (
        docs.select(node_of().alias("node"), "text").join(bounded_broadcast(nodes), "node", "left_semi")
        .groupBy("node").agg(F.first("text").alias("text"))
    )

    def units(parts):
        for batch in slices(parts):
            found, owner = weight_units(*batch_words(batch.column("text").to_pylist()))
            size = np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(owner)), pa.array(size[owner], pa.int64()),
                    pa.array(found.view(np.int64)),
                ],
                ["node", "size", "unit"],
            )

    return texts.mapInArrow(units, "node binary, size long, unit long")


def rare_meetings(
    docs: DataFrame, members: DataFrame, outsiders: DataFrame, similarity: float
) -> DataFrame:
    """Pairs (node, star) of an outsider and a member of another class that may be alike.

    members(node, label), outsiders(node).  Texts of m and n units that are alike share
    at least s(m+n)/(1+s); if units are put in one order, rarest first, then the first
    m-that+1 of one and the first n-that+1 of the other have a unit in common.
    """
    units = stage(with_units(docs, members.select("node")), "units")
    spread = units.groupBy("unit").agg(F.count("*").alias("texts"))
    order = Window.partitionBy("node").orderBy("texts", "unit")
    ranked = units.join(spread, "unit").withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    )
    first = stage(ranked.where("texts > 1").join(members, "node"), "rare-units")
    left = first.join(bounded_broadcast(outsiders), "node", "left_semi")
    right = first.select(
        "unit", F.col("node").alias("star"), F.col("size").alias("star_size"),
        F.col("rank").alias("star_rank"), F.col("label").alias("star_label"),
    )
    shared = F.ceil((F.col("size") + F.col("star_size")) * (similarity / (1 + similarity)) - 1e-9)
    near = left.join(right, "unit").where(
        (F.col("label") != F.col("star_label"))
        & (F.col("rank") <= F.col("size") - shared + 1)
        & (F.col("star_rank") <= F.col("star_size") - shared + 1)
    )
    return near.select("node", "star").distinct()


def link_classes(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame | None:
    """node, label for all nodes that are linked to another; None if there are none."""
    buckets = nodes.select("node", F.explode("keys").alias("bucket"))
    sizes = stage(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    if sizes.isEmpty():
        return None
    shared = stage(buckets.join(bounded_broadcast(sizes), "bucket"), "shared-buckets")
    central = shared.groupBy("node").agg(F.sum("n").alias("meets"))
    placed = stage(shared.drop("n").join(central, "node"), "placed")
    star = F.max_by("node", F.struct("meets", "node"))
    stars = stage(placed.groupBy("bucket").agg(star.alias("star")), "bucket-stars")
    pairs = placed.join(bounded_broadcast(stars), "bucket").where("node != star").select("node", "star").distinct()
    tried = stage(pairs, "pairs")
    links = stage(verify(docs, tried, similarity), "links")
    labels = components(links, "node", "star")

    outsiders = _outsiders(placed, labels)
    if outsiders is None:
        return labels
    salted = outsiders.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(STARS)))
    more = salted.groupBy("bucket", "salt").agg(star.alias("star"), F.max_by("label", F.struct("meets", "node")).alias("star_label"))
    pairs = (
        outsiders.where("outside").join(bounded_broadcast(stage(more, "more-stars")), "bucket")
        .where("label != star_label").select("node", "star").distinct()
    )
    fresh = stage(pairs.join(tried, ["node", "star"], "left_anti"), "pairs")
    links = links.union(stage(verify(docs, fresh, similarity), "links"))
    labels = components(links, "node", "star")

    outsiders = _outsiders(placed, labels)
    if outsiders is None:
        return labels
    members = stage(outsiders.select("node", "label").distinct(), "members")
    outside = stage(outsiders.where("outside").select("node").distinct(), "outside")
    known = tried.union(fresh)
    pairs = rare_meetings(docs, members, outside, similarity).join(known, ["node", "star"], "left_anti")
    links = links.union(stage(verify(docs, stage(pairs, "pairs"), similarity), "links"))
    return components(links, "node", "star")


def _outsiders(placed: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Rows of buckets with several classes: bucket, node, label, meets, outside.

    `outside` marks rows that are not of the class that most rows of their bucket have.
    Any two rows of a bucket in different classes include one of these.
    """
    named = placed.join(bounded_broadcast(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("bucket", "label").agg(F.count("*").alias("rows"))
    main = counts.groupBy("bucket").agg(
        F.max_by("label", F.struct("rows", "label")).alias("main"), F.count("*").alias("classes")
    ).where("classes > 1").drop("classes")
    main = stage(main, "mixed-buckets")
    if main.isEmpty():
        return None
    rows = named.join(bounded_broadcast(main), "bucket").withColumn("outside", F.col("label") != F.col("main"))
    return stage(rows.drop("main"), "mixed-rows")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node, class_id, keeper (the node that stays) of every document."""
    rows = stage(with_bands(docs), "bands")
    nodes = stage(
        rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")), "nodes"
    )
    labels = link_classes(docs.select("text"), nodes, similarity)
    own = nodes.select("node", "least")
    order = F.struct(F.col("least").isNull(), F.col("least"), F.col("node"))
    if labels is None:
        classes = own.withColumns({"class_id": F.col("least"), "keeper": F.col("node")}).drop("least")
    else:
        joined = own.join(bounded_broadcast(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
        linked = joined.join(bounded_broadcast(stage(labels.select("label").distinct(), "classes")), "label", "left_semi")
        heads = stage(
            linked.groupBy("label").agg(F.min(order).alias("head")).select(
                "label", F.col("head.least").alias("class_id"), F.col("head.node").alias("keeper")
            ),
            "heads",
        )
        classes = joined.join(bounded_broadcast(heads), "label", "left").select(
            "node", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("keeper", "node").alias("keeper")
        )
    return rows.select("doc_id", "node").join(stage(classes, "node-classes"), "node")


def duplicate_classes(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: its class, and whether it is the one that stays."""
    found = near_duplicates(docs, **settings)
    stays = (F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return found.select("doc_id", "class_id", stays.alias("stays"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one row of each class: that of the least doc_id, nulls last.

    Rows of the same id and text count as copies; any one of them stays.
    """
    found = near_duplicates(docs, **settings)
    stay = stage(
        found.where((F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).agg(F.count("*").alias("_rows")),
        "stay",
    )
    keyed = docs.withColumn("_node", node_of())
    single, several = stay.where("_rows = 1"), stay.where("_rows > 1")
    match = lambda kept: [F.col("doc_id").eqNullSafe(kept["_id"]), keyed["_node"] == kept["_node"]]
    once = keyed.join(single, match(single), "left_semi").select(*docs.columns)
    again = (
        keyed.join(several, match(several), "left_semi")
        .groupBy("_node").agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    )
    return once.union(again)

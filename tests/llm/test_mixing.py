import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wardspark.llm import mixing

from .conftest import HARD


def sized(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes, weights=(3, 1, 2)):
    """Targets by source, sharing again and again, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    wanted, free, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        left = wanted - sum(target.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if shares[s] > 2 * sizes[s]}
        if not above:
            target |= shares
            break
        target |= {s: Fraction(2 * sizes[s]) for s in above}
        free -= above
    return target


@pytest.fixture
def corpus(make_docs):
    draw = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(draw.choice([0, 1, 3, 30, 200]))), None) for i in range(300)]
    rows += [(i + 300, t, None) for i, t in enumerate(HARD)] + rows[:20] + [(None, "a b", None)] * 5 + [(None, "c", None)]
    source = F.when(F.rand(1) < 0.6, "hot").otherwise(
        F.element_at(F.array(*[F.lit(s) for s in ("a", "B", "é", "", "z", "𝄞", "﹏")], F.lit(None)),
                     (F.rand(2) * 8).cast("int") + 1))
    return make_docs(rows, extra=True).coalesce(1).withColumn("source", source)


def test_targets_and_taken(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + sized(r.text)
    target = brute_targets(sizes)
    rows = mixing.mix_documents(docs, range_rows=37).collect()
    assert len(rows) == docs.count()
    placed = mixing.place_copies(docs, range_rows=37).collect()
    for source, total in sizes.items():
        mine = [r for r in placed if r.source == source]
        assert {r.source_size for r in mine} == {total}
        assert mine[0].target == pytest.approx(float(target[source]))
        assert abs(sum(c.words for r in mine for c in r.copies) - target[source]) <= 0.5
    by_id = {r.doc_id: sized(r.text) for r in docs.collect() if r.doc_id is not None}
    for r in rows:
        assert r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
        assert r.doc_id is None or r.size == by_id[r.doc_id]
    positions = [r.position for r in rows if r.position is not None]
    assert positions == sorted(positions) and all(0 <= p < 1 for p in positions)
    assert all(r.position is None for r in rows[len(positions):])
    # The same rows whatever the partitions and ranges.
    again = mixing.mix_documents(docs.repartition(5), range_rows=1000).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_curriculum_follows_the_schedules(spark, make_docs):
    rows = [(i, "w " * (i % 7 + 1), None) for i in range(3000)]
    docs = make_docs(rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    order = mixing.training_order(docs, range_rows=500).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    for k, schedule in enumerate(mixing.SCHEDULES):
        mine = [r for r in order if r.source == f"s{k}"]
        total = sum(r.words for r in mine)
        for time in (0.25, 0.5, 0.8):
            given = sum(r.words for r in mine if r.position < time) / total
            steps = 1000
            def height(t):
                for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
                    if t <= t1:
                        return w0 + (w1 - w0) * (t - t0) / (t1 - t0)
            area = [height((n + 0.5) / steps) for n in range(steps)]
            assert given == pytest.approx(sum(area[: int(time * steps)]) / sum(area), abs=0.01)


def test_no_words_and_empty(make_docs):
    assert mixing.mix_documents(make_docs([])).collect() == []
    rows = mixing.mix_documents(make_docs([None, "", " "], extra=True)).collect()
    assert [(r.size, r.source_size, r.target, r.taken, r.position) for r in rows] == [(0, 0, 0.0, 0, None)] * 3

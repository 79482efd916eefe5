import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wardspark.llm import queries

from .test_decontamination import brute as passages
from .test_dedup import brute as duplicate_classes, edit
from .test_tokens import check_packed


@pytest.fixture
def folder(spark, tmp_path):
    draw = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    items = [(j, " ".join(prose(30))) for j in range(5)]
    for i in range(240):
        kind = i % 8
        text = prose(draw.randint(40, 160))
        if kind == 0 and rows:
            text = edit(draw.choice([r[1] for r in rows if r[1] and "$" not in r[1] and len(r[1]) > 200]).split(), draw, 1)
        if kind == 1:
            text[10:10] = items[i % 5][1].split()
        if kind == 2:
            text = [w + "$$$" for w in text]
        text = " ".join(text)
        rows.append((i, [text, None, "", "123 %%"][0 if kind < 7 else i // 8 % 4], "en"))
        labels.append((i, int(kind != 2), 0))
    rows += [rows[3], rows[4], (None, rows[5][1], None)]
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    want = [(i, t) for i, t, _ in rows]
    for name, apply in corpus_pipeline.STAGES[:4]:
        if name == "language_id":
            want = [(i, t) for i, t in want if any(map(str.isalpha, t or ""))]
        elif name == "quality_classifier":
            want = [(i, t) for i, t in want if "$" not in t]
        elif name == "near_dedup":
            heads = {c for _, c in duplicate_classes(want)}
            texts = dict(reversed(want))
            want = [(i, texts[i]) for i in heads]
        else:
            held = {i for i, _ in passages(want, items)}
            want = [(i, t) for i, t in want if i not in held]
        docs = corpus_pipeline.stage(apply(spark, docs, path), name)
        assert docs.columns == names
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name
    assert 20 < len(want) < len(rows) - 60
    packed = queries.QUERIES["pipeline"](spark, path).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packed(packed, dict(want), library)


def test_empty_table(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, docs, path)
        assert out.collect() == [], name


def test_clashing_columns_keep_their_values(spark, folder):
    """Columns named like those the stages work with come out as they went in."""
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").dropDuplicates(["doc_id"])
    names = ["score", "lang_pred", "predicted", "label", "node", "k1", "_k1", "class_id", "keeper", "_language", "_is_good",
             "item", "vector", "h", "words"]
    for n, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")))
    for name, apply in corpus_pipeline.STAGES[:4]:
        before = docs.columns
        docs = corpus_pipeline.stage(apply(spark, docs, path), name)
        assert docs.columns == before
        rows = docs.where("doc_id is not null").collect()
        assert rows and all(r[c] == f"{n}:{r.doc_id}" for r in rows for n, c in enumerate(names)), name

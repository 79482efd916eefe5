import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.llm import common, decontamination, dedup, fingerprints

from .conftest import HARD, word_list

SCRIPTS = {
    "han": [chr(c) for c in range(0x4E00, 0x5600)], "thai": [chr(c) for c in range(0x0E01, 0x0E2F)],
    "kana": [chr(c) for c in range(0x3041, 0x3094)], "khmer": [chr(c) for c in range(0x1780, 0x17A3)],
}


def prose(draw, script, n):
    return "".join(draw.choice(SCRIPTS[script]) + (draw.choice("，。、 \u3000") if draw.random() < 0.1 else "") for _ in range(n))


def test_both_forms_give_the_same_words(spark):
    draw = random.Random(2)
    texts = [t or "" for t in HARD] + [
        "no\xa0break — dash…end", "全角！文字、ＡＢＣ １２３", "ไทย ภาษา กขค", "हिन्दी भाषा, शब्द", "e\u0301te\u0301 deja\u0300", "한국어 단어",
        "x漢y字z", "½ ² Ⅷ ٣", "İstanbul ǅ ẞ", "a_b-c", "\u2028line", "ᄀ", "🙂a🙂",
    ]
    texts += [prose(draw, s, 40) for s in SCRIPTS]
    signs = "aé漢ไ한،。 \xa0—1_-\u0301ー々"
    texts += ["".join(draw.choices(signs, k=12)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in frame.select("id", common.words(F.col("text")).alias("w")).collect():
        assert row.w == word_list(texts[row.id]), texts[row.id]
        assert common.word_text(texts[row.id]).split() != [] or not row.w
    hashes, starts = common.batch_words(texts)
    for k, text in enumerate(texts):
        mine = hashes[starts[k] : starts[k + 1]]
        want, _ = common.batch_words([" ".join(word_list(text))])
        assert mine.tolist() == want.tolist(), text


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_texts_without_spaces(spark, make_docs, script):
    """Fingerprints, near copies and benchmark passages, as in texts with spaces."""
    draw = random.Random(script)
    texts = [prose(draw, script, 600) for _ in range(12)]
    near = [t[:200] + draw.choice(SCRIPTS[script]) + t[201:] for t in texts]
    passage = prose(draw, script, 100)
    holds = [t[:300] + passage + t[300:] for t in texts[:4]]
    rows = [(i, t, None) for i, t in enumerate([*texts, *near, *holds])]

    likeness = {r.doc_id: r.near_edited for r in fingerprints.fingerprint_documents(make_docs(rows)).collect()}
    assert 0.45 < np.mean([likeness[i] for i in range(12)]) < 0.75  # three quarters are the same

    classes = {r.doc_id: r.class_id for r in dedup.duplicate_classes(make_docs(rows[:24])).collect()}
    assert all(classes[i] == classes[i + 12] for i in range(12)) and len(set(classes.values())) == 12

    items = spark.createDataFrame([(7, passage), (8, prose(draw, script, 100))], "item_id long, text string")
    found = decontamination.contaminated(make_docs(rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, 7) for i in range(24, 28)}


def test_recall_of_near_copies_in_mixed_scripts(make_docs):
    """All pairs of a shingle similarity of 0.85 and more come into one class; 0.9 is asked."""
    draw = random.Random(5)
    base = []
    for k in range(40):
        script = draw.choice(sorted(SCRIPTS))
        base.append(prose(draw, script, 150) + " " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(60)))
    rows = []
    for k, text in enumerate(base):
        at = draw.randrange(len(text) - 1)
        rows += [(2 * k, text, None), (2 * k + 1, text[:at] + "㐂" + text[at + 1 :], None)]
    classes = {r.doc_id: r.class_id for r in dedup.duplicate_classes(make_docs(rows)).collect()}
    assert sum(classes[2 * k] == classes[2 * k + 1] for k in range(40)) >= 36
    assert len({classes[2 * k] for k in range(40)}) == 40

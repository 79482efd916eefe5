"""Operator 9: licence families of paragraphs by sparse n-gram logistic regression.

Training.  Notices of each family, with words left out in many ways, and paragraphs that
are no licence (a bounded sample of the corpus, and sentences that only sound like one)
train a multinomial logistic regression on the two- and three-word runs of the notices.
One part is kept back to fit a temperature, so that the class `unknown` and the others
have calibrated odds.  The model is a table: run of words -> one weight per class.

Scan.  Paragraphs end at blank lines and at line ends after a full stop, colon, question or
exclamation mark; other lines are joined, so that a wrapped notice is one paragraph, and
signs of comments are taken off.  Every pair of words looks up the table; weights of a
paragraph's distinct runs are added up, and the class with the best odds is predicted.
Only runs in the table move, so texts and ordinary words never shuffle; a paragraph with
no such run has the odds of the bias alone, which are those of `unknown`.  A prediction
is confirmed if a notice of that family has most of its runs in the paragraph.

All of it is column functions and Spark's own estimators.  The result has a row per
paragraph predicted to be of a family.  Null, empty and wordless texts have none, nor has
an empty table; repeated rows of one id and text count once; ids may be null.  A very long
text is as many paragraphs as it has; its runs are counted like any others.  Of classes of
equal odds the first in the order of NOTICES is predicted, `unknown` before all.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_broadcast, stage, words
from .decontamination import text_key
from .learn import DRAWS

UNKNOWN = "unknown"
SAMPLE_DOCUMENTS = 300
SAMPLE_PARAGRAPHS = 4000
VARIANTS = 24
MIN_PROBABILITY = 0.5
MIN_SHARE = 0.5

# Notices by family, as licences and their authors word them.
NOTICES = {
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
        " compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 2",
        "Released under the GNU GPL version 3 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or (at your option) any later version",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring"
        " rights to this work",
    ),
    "isc": (
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
        " is hereby granted",
    ),
}
# Sentences about licences that name no family.
OTHERS = (
    "Licensed under the terms below", "All rights reserved", "This work is licensed to the buyer only",
    "A licence to drive is required by law", "Released under embargo until noon",
    "Released under the name of the author", "You must obtain a license before use",
    "under the terms of the contract", "version 2 of the report", "version 3 of the plan",
    "the general public is welcome", "subject to the terms of the agreement",
    "licensed under a patent held by the company", "this work is part of a series",
    "in compliance with the rules", "the software is sold with or without support",
)


def pairs_and_triples(found: Column) -> Column:
    """Hashes (h2, h3) at every word but the last; h3 is null at the last pair."""
    run = F.transform(
        found,
        lambda w, i: F.struct(
            F.xxhash64(w, F.get(found, i + 1)).alias("h2"),
            F.when(i < F.size(found) - 2, F.xxhash64(w, F.get(found, i + 1), F.get(found, i + 2))).alias("h3"),
        ),
    )
    return F.slice(run, 1, F.greatest(F.lit(0), F.size(found) - 1))


def runs_of(found: Column) -> Column:
    """Distinct hashes of two- and three-word runs."""
    both = pairs_and_triples(found)
    return F.array_distinct(
        F.concat(F.transform(both, lambda r: r["h2"]), F.filter(F.transform(both, lambda r: r["h3"]), lambda h: h.isNotNull()))
    )


COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--)?[ \t]*"
WRAPPED = r"(?<![.!?:\r\n])\r?\n(?![\r\n])"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text key, number and words of every paragraph with two words or more."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), COMMENT, "")
    lines = docs.select(
        "doc_id", *text_key(F.col("text")),
        F.posexplode(F.split(F.regexp_replace(bare, WRAPPED, " "), "[\r\n]+")).alias("paragraph", "line"),
    )
    return lines.select("doc_id", "k1", "k2", "paragraph", words(F.col("line")).alias("w")).where(F.size("w") > 1)


def notices(spark: SparkSession) -> DataFrame:
    """family, notice number, its words."""
    texts = [(f, t) for f, group in NOTICES.items() for t in group]
    rows = F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(n).alias("notice"), F.lit(t).alias("text"))
        for n, (f, t) in enumerate(texts)
    ])
    return spark.range(1).select(F.inline(rows)).select("family", "notice", words(F.col("text")).alias("w"))


def training_rows(docs: DataFrame) -> DataFrame:
    """family, words, kept_back: variants of the notices, and paragraphs of no family."""
    spark = docs.sparkSession
    known = notices(spark)
    others = spark.range(1).select(F.explode(F.array(*map(F.lit, OTHERS))).alias("text")).select(
        F.lit(UNKNOWN).alias("family"), F.xxhash64("text").alias("notice"), words(F.col("text")).alias("w")
    )
    varied = known.unionByName(others).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    drop = F.col("variant") % 4 * 8  # none, 8, 16 or 24 words in a hundred are left out
    varied = varied.withColumn(
        "w", F.filter("w", lambda w, i: F.pmod(F.xxhash64(w, i, "variant"), F.lit(100)) >= drop)
    )
    rows = max(docs.count(), 1)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(DRAWS))
    chosen = docs.where(draw < DRAWS * SAMPLE_DOCUMENTS // rows + 1)
    grams = known.select(F.explode(runs_of(F.col("w"))).alias("run")).distinct()
    name = F.xxhash64("k1", "k2", "paragraph")
    sample = stage(  # in the order of a hash, so that it is the same each time
        paragraphs(chosen).select(name.alias("notice"), "w").orderBy("notice").limit(SAMPLE_PARAGRAPHS), "license-sample"
    )
    # a sampled paragraph that holds a good part of a notice is not taken for an unknown one
    held = (
        sample.select("notice", F.explode(runs_of(F.col("w"))).alias("run")).join(F.broadcast(grams), "run")
        .groupBy("notice").agg(F.count("*").alias("held")).where("held > 2")
    )
    sample = sample.join(F.broadcast(held), "notice", "left_anti")
    every = varied.select("family", F.xxhash64("notice", "variant").alias("key"), "w").union(
        sample.select(F.lit(UNKNOWN), F.col("notice"), "w")
    )
    return every.select("family", "w", (F.pmod("key", F.lit(4)) == 0).alias("kept_back"))


def learn_licenses(docs: DataFrame) -> tuple[DataFrame, list[str], list[float], float]:
    """Table run -> weights by class; the classes, their biases, and the temperature."""
    spark = docs.sparkSession
    classes = [UNKNOWN, *NOTICES]
    grams = notices(spark).select(F.explode(runs_of(F.col("w"))).alias("run")).distinct()
    vocabulary = sorted(str(r.run) for r in grams.collect())  # of the notices alone: a few hundred
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "runs", "features", binary=True)
    rows = training_rows(docs).select(
        F.transform(runs_of(F.col("w")), lambda h: h.cast("string")).alias("runs"), "kept_back",
        (F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1).cast("double").alias("label"),
    )
    staged = stage(vectors.transform(rows).drop("runs"), "license-training").repartition(1)
    model = LogisticRegression(
        maxIter=60, regParam=1e-4, family="multinomial", standardization=False
    ).fit(staged.where("not kept_back"))
    logits = vector_to_array("rawPrediction")
    temperatures = [0.5 * 1.25**k for k in range(14)]
    losses = model.transform(staged.where("kept_back")).select("label", logits.alias("z")).agg(*[
        F.avg(
            F.log(F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp((v - F.array_max("z")) / t)))
            - (F.get("z", F.col("label").cast("int")) - F.array_max("z")) / t
        ).alias(f"t{k}")
        for k, t in enumerate(temperatures)
    ]).first()
    best = min(range(len(temperatures)), key=lambda k: (losses[k] if losses[k] is not None else 0.0, k))
    matrix = model.coefficientMatrix.toArray()
    seen = list(model.interceptVector)
    weights = F.array(*[
        F.struct(F.lit(int(run)).alias("run"), F.array(*[F.lit(float(v)) for v in matrix[:, j]]).alias("weights"))
        for j, run in enumerate(vocabulary)
    ])
    table = stage(spark.range(1).select(F.inline(weights)), "license-model")
    return table, classes[: len(seen)], [float(v) for v in seen], temperatures[best]


def scan_licenses(docs: DataFrame, min_probability: float = MIN_PROBABILITY, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, paragraph, family, probability, notice_share, confirmed."""
    spark = docs.sparkSession
    table, classes, biases, temperature = learn_licenses(docs)
    table = bounded_broadcast(table)
    key = ["doc_id", "k1", "k2", "paragraph"]
    places = paragraphs(docs).select(*key, F.explode(pairs_and_triples(F.col("w"))).alias("r"))
    starts = table.select(F.col("run").alias("h2"), F.lit(True).alias("known"))
    hits = places.select(*key, "r.h2", "r.h3").join(F.broadcast(starts), "h2")
    runs = stage(
        hits.select(*key, F.explode(F.array("h2", "h3")).alias("run")).join(table.select("run"), "run", "left_semi")
        .distinct(),
        "license-runs",
    )
    scored = runs.join(table, "run").groupBy(*key).agg(*[
        (F.sum(F.get("weights", i)) + biases[i]).alias(f"z{i}") for i in range(len(classes))
    ])
    z = F.array(*[F.col(f"z{i}") / temperature for i in range(len(classes))])
    odds = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    predicted = scored.withColumn("odds", odds).select(
        *key,
        F.get(F.array(*map(F.lit, classes)), F.array_position("odds", F.array_max("odds")).cast("int") - 1).alias("family"),
        (F.array_max("odds") / F.aggregate("odds", F.lit(0.0), lambda s, v: s + v)).alias("probability"),
    ).where((F.col("family") != UNKNOWN) & (F.col("probability") >= min_probability))
    templates = notices(spark).select("family", "notice", F.size(runs_of(F.col("w"))).alias("size"), F.explode(runs_of(F.col("w"))).alias("run"))
    shares = (
        runs.join(F.broadcast(templates), "run").groupBy(*key, "family", "notice", "size").agg(F.count("*").alias("held"))
        .groupBy(*key, "family").agg(F.max(F.col("held") / F.col("size")).alias("notice_share"))
    )
    same = [predicted[c].eqNullSafe(shares[c]) for c in [*key, "family"]]
    return predicted.join(shares, same, "left").select(
        predicted["doc_id"], predicted["paragraph"], predicted["family"], "probability",
        F.coalesce("notice_share", F.lit(0.0)).alias("notice_share"),
        (F.coalesce("notice_share", F.lit(0.0)) >= min_share).alias("confirmed"),
    )

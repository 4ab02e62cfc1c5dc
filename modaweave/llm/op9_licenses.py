"""Licence scans: a trained paragraph classifier with template comparison.

Paragraphs are lines; long ones are cut into overlapping windows of words.  Those with a licence cue
get word n-gram features and a multinomial logistic regression names a family, ``none`` or
``unknown``.  A probability below the calibrated limit is ``unknown`` as well, and a family counts as
confirmed only if the paragraph shares enough word pairs with one of its templates.

A line gives a row for each notice, with the place of its window: every STEP words with a cue speak
through the better of the two windows over them (a family before ``unknown``, then the likelier), and
overlapping windows of one family are one notice.  Two notices inside one window are named as one.

All texts are read whole; null and empty texts give no rows.  Paragraphs taken for ``none`` give no
row.  Repeated rows are scanned one by one; of equally likely windows the first counts; empty tables
give empty results; other columns are ignored.  DataFrame functions and Spark ML stages only.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, unit_hash

# Public notices of licence families.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0.", "This project is available under the terms of the Apache 2.0 license."),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Released under the MIT License.", "This software is licensed under the MIT license."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License.", "Released under the BSD license."),
    "GPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2 or later."),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 2.1."),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "This program is distributed under the terms of the GNU Affero General Public License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-ND": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0."),
}
UNKNOWN = ("All rights reserved.", "Copyright by the authors. No part may be reproduced without written permission.", "Licensed under the terms in the LICENSE file.", "This text is under a proprietary license of the publisher.", "Use is subject to a separate license agreement.", "Distributed under a custom licence; contact the owner for permission.")
NOT_ONE = ("He had a driving license and a fishing license.", "The city may license more taxis next year.", "They asked for permission to leave the house.", "The copyright debate went on in parliament.", "Public transport in the domain of the king.", "The new album was released on Friday under a bright moon.")
CUE = "(?i)licen[cs]|copyright|all rights reserved|public domain|creative commons|permission is hereby|redistribut|\\bgpl\\b|\\bcc[ -]?(?:by|0)"

WINDOW, STEP = 40, 20
HASHES = 1 << 12


def words_of(column: str | Column) -> Column:
    return F.filter(F.split(F.lower(column), "[^\\p{L}\\p{N}.-]+|[.](?![0-9])|(?<![0-9])[.]"), lambda w: w != "")


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, _r, line (0-based), at (first word), words of all windows with a cue."""
    rows = docs.filter(F.col("text").rlike(CUE)).select("doc_id", "_r", F.posexplode(F.split("text", "\n")).alias("line", "p")).filter(F.col("p").rlike(CUE))
    whole = rows.select("doc_id", "_r", "line", words_of("p").alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - WINDOW + STEP - 1), F.lit(STEP))
    cut = whole.select("doc_id", "_r", "line", "_w", F.explode(starts).alias("at"))
    cut = cut.select("doc_id", "_r", "line", "at", F.slice("_w", F.col("at") + 1, WINDOW).alias("words"))
    return cut.filter(F.array_join("words", " ").rlike(CUE))


def _variants(text: str) -> list[str]:
    """The text, its halves with the names in them, and the text among other words."""
    w = text.split()
    out = [text, " ".join(w[: max(5, 2 * len(w) // 3)]), "copyright 2020 by us . " + text, text + " see the file for details", "note that " + text]
    return out + ([" ".join(w[len(w) // 3 :])] if len(w) > 12 else [])


def training(docs: DataFrame, most: int = 2000, seed: int = 9) -> DataFrame:
    """label, words: variants of the templates, generic notices, and about ``most`` lines of the
    corpus without a cue, chosen by hash, as ``none``."""
    spark: SparkSession = docs.sparkSession
    rows = [(f, v) for f, ts in TEMPLATES.items() for t in ts for v in _variants(t)]
    rows += [("unknown", v) for t in UNKNOWN for v in _variants(t)] + [("none", v) for t in NOT_ONE for v in _variants(t)]
    fixed = spark.createDataFrame(rows, "label string, t string").select("label", words_of("t").alias("words"))
    n = docs.filter("text is not null").count()
    # Rows that are repeated share a hash: they count once.
    picked = docs.filter("text is not null").filter(unit_hash("doc_id", "text", seed=seed) < min(1.0, most / max(1, n))).dropDuplicates(["doc_id", "text"])
    at = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.size(F.split("text", "\n")))
    line = picked.select(F.split("text", "\n")[at.cast("int")].alias("t")).filter(~F.col("t").rlike(CUE))
    plain = line.select(F.lit("none").alias("label"), F.slice(words_of("t"), 1, WINDOW).alias("words"))
    return fixed.union(plain)


def _features() -> list:
    return [NGram(n=2, inputCol="words", outputCol="_g2"), HashingTF(numFeatures=HASHES, inputCol="words", outputCol="_f1", binary=True), HashingTF(numFeatures=HASHES, inputCol="_g2", outputCol="_f2", binary=True), VectorAssembler(inputCols=["_f1", "_f2"], outputCol="_x")]


def families() -> list[str]:
    return ["none", "unknown", *TEMPLATES]


def fit(rows: DataFrame, penalty: float = 2e-3) -> tuple[PipelineModel, float]:
    """The classifier and the calibrated limit: what 99 of 100 rows kept back for it reach, when a
    model that has not seen them names their family rightly."""
    names = families()
    code = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("label")) - 1
    data = stored(rows.select(code.cast("double").alias("y"), "words", (unit_hash("label", "words", seed=4) < 0.25).alias("back")).coalesce(4), "licence-training")
    model = lambda d: Pipeline(stages=[*_features(), LogisticRegression(featuresCol="_x", labelCol="y", family="multinomial", regParam=penalty, maxIter=60, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred")]).fit(d)
    trial = model(data.filter("not back")).transform(data.filter("back")).filter("y > 1 and _pred = y")
    reached = trial.select(F.array_max(vector_to_array("_p")).alias("p")).agg(F.percentile("p", 0.01)).first()[0]
    return model(data), min(max(reached or 0.5, 0.3), 0.9)


def template_pairs(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    return spark.createDataFrame(rows, "family string, t string").select("family", _pairs(words_of("t")).alias("_tp"))


def _pairs(words: Column) -> Column:
    n = F.size(words)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 2), " ")))


def notices(named: DataFrame) -> DataFrame:
    """The best window of every notice, from all windows (_r, line, at, words, family, probability).

    A window's groups are its own line's, so no group is larger than one text.
    """
    rank = F.struct((F.col("family") != "unknown").alias("k"), F.col("probability").alias("p"), (-F.col("at")).alias("o"))
    line = W.partitionBy("_r", "line").orderBy("at")
    cue = lambda start: F.array_join(F.slice("words", start, STEP), " ").rlike(CUE)
    ranked = named.withColumn("_rank", rank).withColumn("_late", cue(STEP + 1))
    ranked = ranked.withColumn("_early", cue(1) | ~F.col("_late"))  # also a cue that lies across the middle
    beside = lambda by: F.max("_rank").over(line.rangeBetween(by, by))
    speaks = lambda by: F.coalesce(F.col("_rank") > beside(by), F.lit(True))
    ranked = ranked.withColumn("_speaks", (F.col("_early") & speaks(-STEP)) | (F.col("_late") & speaks(STEP)))
    family = W.partitionBy("_r", "line", "family").orderBy("at")
    kept = ranked.filter("_speaks").withColumn("_new", F.coalesce(F.col("at") - F.lag("at").over(family) >= WINDOW, F.lit(True)).cast("int"))
    kept = kept.withColumn("_notice", F.sum("_new").over(family))
    best = kept.groupBy("_r", "line", "family", "_notice").agg(F.max_by(F.struct("doc_id", "at", "_best", "probability", "words"), "_rank").alias("_b"))
    return best.select("_r", "line", "family", "_b.*")


def scan(docs: DataFrame, least_similarity: float = 0.6) -> DataFrame:
    """doc_id, line, at (first word of the notice's window), family, probability, similarity, confirmed
    of stored or keyed rows (_r)."""
    spark = docs.sparkSession
    model, limit = fit(training(docs))
    names = F.array(*[F.lit(x) for x in families()])
    found = stored(windows(docs), "licence-windows")
    p = vector_to_array("_p")
    named = model.transform(found).select("doc_id", "_r", "line", "at", "words", p.alias("_v")).withColumn("probability", F.array_max("_v"))
    named = named.withColumn("_best", F.element_at(names, F.array_position("_v", F.col("probability")).cast("int")))
    named = named.filter("_best <> 'none'").withColumn("family", F.when(F.col("probability") < limit, F.lit("unknown")).otherwise(F.col("_best"))).drop("_v")
    best = notices(named).withColumn("_wp", _pairs(F.col("words")))
    pairs = template_pairs(spark).groupBy("family").agg(F.collect_list("_tp").alias("_tps")).select(F.col("family").alias("_f"), "_tps")  # a few fixed rows
    near = best.join(F.broadcast(pairs), F.col("_best") == F.col("_f"), "left")
    shares = F.transform("_tps", lambda t: F.size(F.array_intersect(t, F.col("_wp"))) / F.least(F.size(t), F.size("_wp")))
    near = near.withColumn("similarity", F.coalesce(F.array_max(shares), F.lit(0.0)))
    return near.select("doc_id", F.col("line").cast("bigint").alias("line"), F.col("at").cast("bigint").alias("at"), "family", "probability", "similarity", ((F.col("family") != "unknown") & (F.col("similarity") >= least_similarity)).alias("confirmed"))


def op9(docs: DataFrame, **settings) -> DataFrame:
    out = scan(docs.withColumn("_r", F.monotonically_increasing_id()), **settings)
    return out.withColumn("probability", F.round("probability", 6)).withColumn("similarity", F.round("similarity", 6))

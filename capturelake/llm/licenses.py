"""License scans with DataFrame functions only: a trained paragraph classifier confirmed by templates.

Paragraphs are lines. Features are the word 1- to 3-grams of the licence notices below that hold an anchor word, a
notice word which ordinary paragraphs hardly use; a paragraph without anchor words has no features and is ordinary.
A multinomial logistic regression over families, `unknown` and `none` is trained on the notices in ordinary context,
invented notices that name no known licence (`unknown`) and ordinary paragraphs, at most SAMPLE of them. A family stands
if its probability reaches the threshold calibrated on held-out rows and a template of it is contained in the paragraph
by at least CONFIRM of its 2-grams; a licence-like paragraph without both is `unknown`.

Null and empty texts have one empty, ordinary paragraph. Extra columns are ignored, repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import hash_sample

#: Fixed wording of usual notices, by family.
NOTICES = {
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 public domain dedication"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "either version 2 of the GNU General Public License, or any later version"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "either version 3 of the GNU General Public License, or any later version"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without permission.", "Copyright, all rights reserved, confidential and proprietary"],
}
UNKNOWN = ["Licensed under the {} License.", "Released under the {} Licence, version 9.", "This work is licensed under the {} Public License.", "Distributed under the terms of the {} license agreement.", "See the {} license for details."]
SAMPLE = 2_000
CONFIRM = 0.6
FLOOR = 0.5


def _words(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"), F.lit(0))


def _grams(words) -> F.Column:
    n = F.size(words)
    joined = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, joined(2), joined(3))


def _bigrams(words) -> F.Column:
    return F.array_distinct(F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " "))).otherwise(words))


def _paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "text"))


class Classifier:
    """Vocabulary, regression and threshold; all of fixed size."""

    def __init__(self, spark, docs: DataFrame) -> None:
        notices = spark.createDataFrame([(family, text) for family, texts in NOTICES.items() for text in texts], "family string, notice string")
        some = hash_sample(docs.where("text is not null and text <> ''"), "doc_id", SAMPLE).select(F.substring(F.element_at(F.split("text", "\n"), 1), 1, 400).alias("line"))
        plain = [r.line for r in some.collect() if r.line.strip()]  # at most SAMPLE lines
        ordinary = spark.createDataFrame([(p,) for p in plain if "licen" not in p.lower()] or [("",)], "line string")
        usual = {r.w for r in ordinary.select(F.explode(F.array_distinct(_words(F.col("line")))).alias("w")).groupBy("w").count().where(F.col("count") > len(plain) / 500).collect()}
        worded = [(r.family, r.w) for r in notices.select("family", _words(F.col("notice")).alias("w")).collect()]
        self.anchors = sorted({w for _, ws in worded for w in ws if w not in usual and len(w) > 1 and not w[0].isdigit() and w not in _COMMON})
        anchors = set(self.anchors)
        grams = {" ".join(ws[i : i + k]) for _, ws in worded for k in (1, 2, 3) for i in range(len(ws) - k + 1)}
        self.vocabulary = sorted(g for g in grams if anchors & set(g.split()))
        context = [p for p in plain if "licen" not in p.lower()][:60] or [""]
        names = [w for p in context for w in p.split() if w.isalpha()][:60] or ["other"]
        rows = [(family, shape.format(text, c)) for family, texts in NOTICES.items() for text in texts for c in context[:12] for shape in ("{0}", "{0} {1}", "{1} {0}")]
        rows += [("unknown", u.format(n.capitalize())) for u in UNKNOWN for n in names]
        rows += [("none", p) for p in plain if "licen" not in p.lower()]
        rows += [("none", w) for w in self.anchors if w not in ("licensed", "license", "licenses", "licence")]
        self.families = ["none", "unknown", *NOTICES]
        self.vectors = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
        self.vectors.setBinary(True)
        label = F.array_position(F.lit(self.families), F.col("family")) - 1
        data = self.vectors.transform(spark.createDataFrame(rows, "family string, line string").select(label.cast("double").alias("label"), "line", _grams(_words(F.col("line"))).alias("grams")))
        data = data.withColumn("fold", F.pmod(F.xxhash64("line"), F.lit(5))).cache()
        self.model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(data.where("fold <> 0"))
        held = self.model.transform(data.where("fold = 0 and label >= 2"))
        low = held.select(F.try_element_at(vector_to_array("probability"), F.col("label").cast("int") + 1).alias("p")).agg(F.percentile("p", F.lit(0.02)).alias("p")).first()
        data.unpersist()
        self.threshold = max(FLOOR, min(low.p if low.p is not None else FLOOR, 0.9))
        self.templates = notices.groupBy("family").agg(F.collect_list(_bigrams(_words(F.col("notice")))).alias("templates"))

    def paragraphs(self, docs: DataFrame) -> DataFrame:
        """row, doc_id, paragraph, family, probability, containment of every licence-like paragraph."""
        lines = _paragraphs(docs).withColumn("words", _words(F.col("text"))).where(F.arrays_overlap("words", F.lit(self.anchors)))
        scored = self.model.transform(self.vectors.transform(lines.withColumn("grams", _grams(F.col("words")))))
        p = vector_to_array("probability")
        best = scored.select("row", "doc_id", "paragraph", "words", F.element_at(F.lit(self.families), F.col("prediction").cast("int") + 1).alias("family"), F.array_max(p).alias("probability")).where("family <> 'none'")
        held = best.join(F.broadcast(self.templates), "family", "left")  # one row per family of NOTICES
        inside = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("mine"))) / F.size(t)))
        held = held.withColumn("mine", _bigrams(F.col("words"))).withColumn("containment", F.coalesce(inside, F.lit(0.0)))
        sure = (F.col("probability") >= self.threshold) & (F.col("containment") >= CONFIRM)
        return held.select("row", "doc_id", "paragraph", F.when(sure, F.col("family")).otherwise(F.lit("unknown")).alias("family"), "probability", "containment")


#: Function words and plain verbs that notices share with any prose.
_COMMON = frozenset("a all an and any are as at by either except file for form forms free in is later may met not no of or part possible related related source subject terms that the this to under use used with without work you copy extent following following law person program provided purpose fee of".split())


def license_scan(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_paragraphs, n_licence, n_unknown, families (sorted, comma-joined), and the surest family's probability and containment."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    spark = documents.sparkSession
    found = Classifier(spark, docs).paragraphs(docs)
    found = found.groupBy("row", "paragraph").agg(F.first("family").alias("family"), F.first("probability").alias("probability"), F.first("containment").alias("containment"))
    known = F.col("family") != "unknown"
    per = found.groupBy("row").agg(
        F.count_if(known).alias("n_licence"),
        F.count_if(~known).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("family")))), ",").alias("families"),
        F.max(F.when(known, F.struct("probability", "containment"))).alias("best"),
    )
    base = docs.select("doc_id", "row", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_paragraphs"))
    return base.join(per, "row", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_licence", F.lit(0)).alias("n_licence"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        F.coalesce("families", F.lit("")).alias("families"), F.round(F.col("best.probability"), 4).alias("probability"), F.round(F.col("best.containment"), 4).alias("containment"),
    )

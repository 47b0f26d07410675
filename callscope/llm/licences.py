"""Licence scans (operator 7), with DataFrame functions only.

A paragraph ends at a blank line, or one of comment marks only. Of each that holds a licence word, the single lines, the sentences and clauses across
its wrapped lines, and overlapping windows of ``2 * SPAN`` words are units; those with a licence word are classified by a multinomial logistic regression over hashed word unigrams and
bigrams. It is trained on notices of each family with words left out by hash, and on paragraphs of no
family. The class of no family is calibrated: a family is only claimed from the probability that ``1 - miss`` of
held-out notices of the families reach. A claim is confirmed if the share of a template's word bigrams that the unit
contains is at least ``overlap`` for some template of that family.

Defined results: null and empty texts, and texts without a licence word, have no family (``none``); a licence paragraph of no known
family is ``unknown``; ``families`` has all confirmed families of a document, ``family`` the most probable one; repeated rows are
scanned each; a null id stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import materialize

#: Short public notices of each family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GNU GPL version 3.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "reserved": ["Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission of the publisher."],
}
#: Licence words in sentences of no family.
OTHER = [
    "You need a driving licence to rent a car.",
    "The licence fee was raised again this year.",
    "She asked for permission to leave the room early.",
    "The software comes with a warranty of two years.",
    "Read the license before you sign anything.",
    "The licensed restaurant stays open until midnight.",
    "A copyright lawyer spoke about public policy and work.",
    "The apache helicopter landed near the general.",
    "Licensed under terms that are listed elsewhere.",
    "Released under a new name in version 3 of the series.",
]
WORDS = r"licen[cs]|copyright|rights reserved|permission|redistribut|warrant|creative commons|public domain|\bGPL\b"
FAMILIES = [*TEMPLATES, "other"]
MARKS = r"[ \t\r#*/;!%-]*"  # of comments, at the start of a line
LICENSED = "(?i)" + WORDS.replace(" ", "[^a-z0-9]+")  # across wrapped lines too
SPAN = 64  # more words than any template has


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.\-]+|\.(?=\s|$)"), lambda w: w != "")


def pairs(words: Column) -> Column:
    """Distinct adjacent pairs of words."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def units(paragraphs: DataFrame) -> DataFrame:
    """``row_id, p``, what is classified of each ``paragraph``: lines, sentences and clauses across lines, and windows in which each run of ``SPAN`` words is whole."""
    # columns of their own, as a lambda function would work them out again for each window
    held = paragraphs.withColumn("joined", F.regexp_replace("paragraph", rf"\n{MARKS}", " ")).withColumn("w", tokens(F.col("joined"))).withColumn("n", F.size("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / SPAN).cast("int") - 2))
    windows = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i * SPAN + 1, F.lit(2 * SPAN))))
    parts = F.concat(F.split("paragraph", r"\n"), F.split("joined", r"(?<=[.!?])\s+"), F.split("joined", r"(?<=[.!?:;])\s+"), windows)
    return held.select("row_id", F.explode(F.array_distinct(F.filter(parts, lambda u: u.rlike(LICENSED)))).alias("p"))


def notices(spark: SparkSession, copies: int) -> DataFrame:
    """Training paragraphs: each notice, and copies of it that lack about a sixth of the words."""
    rows = [(t, FAMILIES.index(f), f) for f, ts in TEMPLATES.items() for t in ts] + [(t, FAMILIES.index("other"), "other") for t in OTHER]
    base = spark.createDataFrame(rows, "paragraph string, label int, family string")
    every = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    kept = F.filter(tokens(F.col("paragraph")), lambda w, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(w, i, F.col("copy")), F.lit(6)) > 0))
    return every.withColumn("words", kept).withColumn("label", F.col("label").cast("double"))


class Scanner:
    def __init__(self, spark: SparkSession, *, copies: int = 40, miss: float = 0.02, bits: int = 14) -> None:
        self.spark = spark
        stages = [NGram(n=2, inputCol="words", outputCol="__pairs"), HashingTF(numFeatures=1 << bits, binary=True, inputCol="words", outputCol="__f1"), HashingTF(numFeatures=1 << bits, binary=True, inputCol="__pairs", outputCol="__f2"), VectorAssembler(inputCols=["__f1", "__f2"], outputCol="__features")]
        learn = LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__probability", predictionCol="__class", rawPredictionCol="__raw", regParam=0.001, maxIter=60, family="multinomial")
        rows = notices(spark, copies).coalesce(4)  # a fixed number of notices
        late = F.col("copy") % 4 == 3
        self.model = Pipeline(stages=[*stages, learn]).fit(rows.where(~late))
        p = F.element_at(vector_to_array("__probability"), F.col("label").cast("int") + 1)
        self.least = self.model.transform(rows.where(late & (F.col("family") != "other"))).agg(F.percentile(p, F.lit(miss))).first()[0]

    def classified(self, paragraphs: DataFrame) -> DataFrame:
        """``paragraphs`` (with ``words``) and ``family``, ``confidence``; ``unknown`` under the calibrated bound."""
        out = self.model.transform(paragraphs)
        best = F.col("__class").cast("int")
        confidence = F.element_at(vector_to_array("__probability"), best + 1)
        names = F.array(*[F.lit(f) for f in FAMILIES])
        named = F.when((confidence >= self.least) & (best != FAMILIES.index("other")), F.element_at(names, best + 1)).otherwise("unknown")
        return out.withColumn("confidence", confidence).withColumn("family", named).drop("__pairs", "__f1", "__f2", "__features", "__raw", "__probability", "__class")


def scan(docs: DataFrame, *, overlap: float = 0.6, text: str = "text", key: str = "doc_id", scanner: Scanner | None = None) -> DataFrame:
    """``doc_id, family, families, confidence, n_paragraphs`` (that hold a licence word) of each document."""
    spark = docs.sparkSession
    s = scanner or Scanner(spark)
    t = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    held = F.filter(F.split("t", rf"\n{MARKS}\n"), lambda p: p.rlike(LICENSED))
    with_id = materialize(t.withColumn("row_id", F.monotonically_increasing_id()).withColumn("held", held).drop("t"), "licence-paragraphs")
    each = units(with_id.where(F.size("held") > 0).select("row_id", F.explode("held").alias("paragraph"))).withColumn("words", tokens(F.col("p")))
    templates = [(f, F.array(*[F.lit(x) for x in template_pairs(x)])) for f, xs in TEMPLATES.items() for x in xs]
    seen = pairs(F.col("words"))
    likeness = [F.when(F.col("family") == f, F.size(F.array_intersect(seen, a)) / F.size(a)) for f, a in templates]
    claimed = s.classified(each).withColumn("likeness", F.greatest(F.lit(0.0), *likeness))
    sure = claimed.withColumn("family", F.when(F.col("likeness") >= overlap, F.col("family")).otherwise("unknown")).withColumn("rank", (F.col("family") != "unknown").cast("int"))
    best = sure.groupBy("row_id").agg(F.max(F.struct("rank", "confidence", "family")).alias("b"), F.array_sort(F.collect_set(F.when(F.col("rank") == 1, F.col("family")))).alias("families"))
    out = with_id.select("doc_id", "row_id", F.size("held").alias("n")).join(best, "row_id", "left")
    return out.select("doc_id", F.coalesce("b.family", F.lit("none")).alias("family"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.round(F.coalesce("b.confidence", F.lit(0.0)), 4).alias("confidence"), F.col("n").cast("long").alias("n_paragraphs"))


def template_pairs(text: str) -> list[str]:
    import re

    words = [w for w in re.split(r"[^a-z0-9.\-]+|\.(?=\s|$)", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))

"""Learned operators: held-out accuracy, brute-force counts, odd rows."""

import math
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import entry, licences, perplexity, quality, toxicity


def test_toxicity_on_held_out_labels(spark, sf_dir):
    """Of toxic held-out documents 70 % are found at least, and of those found 70 % are toxic; a constant answer has neither."""
    big = sf_dir.replace("0.001", "0.1")
    got = entry.op9_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    right = sum(r["predicted"] and r["toxic"] for r in got)
    assert sum(r["toxic"] for r in got) > 100
    assert right >= 0.7 * sum(r["toxic"] for r in got) and right >= 0.7 * sum(r["predicted"] for r in got)


def test_words_that_differ_in_a_letter_fold_apart():
    assert len({toxicity.fold(w) for w in ("größer", "grüßer", "grasser", "слово", "слива")}) == 5
    assert toxicity.fold("Größe!") == toxicity.fold("grosse") == toxicity.fold("gr-o-s-s-e")


def test_toxicity_of_ties_and_repeated_rows(spark, labels):
    rows = [(i % 40, f"you are a stupid blargface number {i % 20}." if i % 2 else f"what a lovely morning number {i % 20}.") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic").distinct()
    got = toxicity.score(docs, toxicity.fitted(docs, known)).collect()
    assert len(got) == 80 and len({(r["text"], r["score"]) for r in got}) == 20


def test_inserted_letters_are_seen():
    rows = [(f"what a stupid blargface you are number {i}." if i % 2 else f"what a lovely morning it is number {i}.", i % 2) for i in range(120)]
    m = toxicity.train(rows)
    p = lambda t: m.learn_words(set(toxicity.folded(t.split()))) or m.probability(t.split(), toxicity.folded(t.split()))
    assert p("you blaargface.") > 0.3 > p("a lovely morning.")


def test_kernel_bound_rules_out_nothing_that_counts():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(1, 6, rng.integers(3, 20)).tolist()) for _ in range(400)]
    k = toxicity.Kernel([bytes([1, 2, 3, 4, 5, 1]), bytes([2, 2, 3, 1, 4])])
    maybe = set(k.maybe(sorted(set(words))))
    assert all(w in maybe for w in words if k.of(w).any())


@pytest.mark.parametrize("with_labels", [True, False])
def test_odd_rows(odd_docs, no_docs, labels, with_labels):
    known = labels if with_labels else labels.limit(0)
    plain = odd_docs.drop("score", "kept", "probability")
    for docs in (plain, plain.limit(0)):
        n = docs.count()
        assert toxicity.score(docs, toxicity.fitted(docs, known)).count() == n
        assert quality.score(docs, quality.fitted(docs, known)).count() == n
        assert perplexity.judged(docs, known).count() == n
    assert toxicity.drop_toxic(odd_docs, known).columns == odd_docs.columns
    assert quality.keep_good(odd_docs, known).columns == odd_docs.columns
    assert perplexity.keep_fluent(odd_docs, known).columns == odd_docs.columns


def slow_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    cover = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_against_brute_force(spark, sf_dir, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = entry.op5_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_on_labels_it_has_not_seen():
    """Learned on three quarters of the labelled rows: nine of ten good ones of the rest stay, and the bad ones that pass the rules go."""
    import zlib

    import oracle

    rows = oracle.connection("/root/testdata/sf0.1").execute("SELECT doc_id, coalesce(text, ''), quality FROM documents JOIN labels USING (doc_id) ORDER BY doc_id").fetchall()
    late = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 1]
    model = quality.train([(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 1 and len(t) < 20_000][:3000])
    good, kept, bad, caught = 0, 0, 0, 0
    for _, t, y in late:
        words = t.encode().split()
        rules = quality.rules(t, words)
        if rules[0] >= quality.LEAST_WORDS and 100 * rules[4] <= quality.MOST_REPEATED * rules[0]:
            keep = model.probability(t.encode(), words) >= quality.THRESHOLD
            good, kept, bad, caught = good + y, kept + y * keep, bad + 1 - y, caught + (1 - y) * (not keep)
    assert good > 500 and bad > 50 and kept >= 0.9 * good and caught >= 0.9 * bad


def test_quality_on_labels(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    got = entry.op5_quality_rules(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] for r in got if r["quality"] == 1) >= 0.9 * sum(r["quality"] for r in got)


def test_perplexity_against_brute_force(spark, docs, labels):
    """The model by plain dictionaries gives the same perplexities."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    good = {r["doc_id"] for r in labels.where("quality = 1").where(~perplexity.calibrates(F.col("doc_id"))).collect()}

    def pair(t):
        c = perplexity.word_classes((t or "").encode().lower().split()).tolist()
        return list(zip(c, c[1:]))

    n = Counter(p for i, t in rows if i in good for p in pair(t))
    d = perplexity.discounts_of([sum(c == k for c in n.values()) for k in (1, 2, 3, 4)])
    total, mass, cont = Counter(), Counter(), Counter()
    for (v, w), c in n.items():
        total[v] += c
        mass[v] += d[min(c, 3)]
        cont[w] += 1
    size = 1 << perplexity.VOCABULARY
    p1 = lambda w: (cont[w] + 1 / size) / (len(n) + 1)
    got = {r["doc_id"]: r for r in perplexity.judged(docs, labels).collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, t in rows:
        p = pair(t)
        assert got[i]["n_bigrams"] == len(p)
        if p:
            log = [math.log((max(n[v, w] - d[min(n[v, w], 3)], 0) / total[v] if n[v, w] else 0) + (mass[v] / total[v] if total[v] else 1) * p1(w)) for v, w in p]
            assert got[i]["perplexity"] == pytest.approx(math.exp(-sum(log) / len(log)), rel=1e-3)
    # thresholds: the 0.995 quantile of the held-out trusted documents of a language, of all where it has none
    late = {r["doc_id"] for r in labels.where("quality = 1").where(perplexity.calibrates(F.col("doc_id"))).collect()}
    held = [r for r in got.values() if r["doc_id"] in late and r["perplexity"] is not None]
    at = lambda some: sorted(some)[max(0, math.ceil(0.995 * len(some)) - 1)]
    for r in got.values():
        own = [h["perplexity"] for h in held if h["lang"] == r["lang"]] or [h["perplexity"] for h in held]
        assert r["threshold"] == at(own) and r["kept"] == (r["perplexity"] is None or r["perplexity"] <= at(own))


def test_licences(spark):
    rows = [(1, "Intro.\nLicensed under the MIT License.\nMore."), (2, "You need a driving licence to rent a car."), (3, "nothing here"), (4, None), (5, "Licensed under the Apache License, Version 2.0."), (6, "Released under the zorp licence of nobody"), (None, "Licensed under CC BY 4.0."), (8, "")]
    got = {r["doc_id"]: r["family"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "MIT" and got[5] == "Apache-2.0" and got[None] == "CC-BY-4.0"
    assert got[2] == got[6] == "unknown" and got[3] == got[4] == got[8] == "none"


def test_wrapped_and_double_licence_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify and sell copies of the Software."
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at the address below."
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    prose = "A plain line about rivers and hills that says nothing of the terms."
    rows, want = [], {}
    for width in (30, 44, 72):
        for mark in ("", "# ", " * ", "-- "):
            for families, texts in ((["MIT"], [mit]), (["Apache-2.0"], [apache]), (["GPL-3.0"], [gpl]), (["BSD"], [bsd]), (["Apache-2.0", "MIT"], [mit, apache]), (["BSD", "GPL-3.0"], [bsd, gpl])):
                for gap in ("\n", f"\n{mark.rstrip()}\n") if len(texts) > 1 else ("\n",):
                    block = gap.join("\n".join(mark + x for x in textwrap.wrap(t, width)) for t in texts)
                    want[len(rows)] = families
                    rows.append((len(rows), f"{prose}\n\n{block}\n\n{prose}"))
    want[len(rows)] = ["Apache-2.0", "MIT"]
    rows.append((len(rows), "Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0."))
    want[len(rows)] = []
    rows.append((len(rows), f"{prose}\n\n{prose}\nYou need a driving\nlicence to rent a car."))
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = {i: (got[i]["families"], f, rows[i][1]) for i, f in want.items() if got[i]["families"] != f or (got[i]["family"] not in f if f else got[i]["family"] != "unknown")}
    assert not wrong

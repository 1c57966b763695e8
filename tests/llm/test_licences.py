import math

import pytest
from pyspark.sql import functions as F

from telerisk.llm import licences as L


@pytest.fixture(scope="module")
def classifier(spark):
    return L.train(spark)


def test_templates_variants_and_others(spark, classifier):
    lines = {
        1: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 2: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        3: ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), 4: ("Released under the MIT License.", "mit"), 5: ("All rights reserved.", "all-rights-reserved"),
        6: ("(c) 2020 Foo. ALL RIGHTS RESERVED", "all-rights-reserved"), 7: ("and now licensed under the terms of the GNU Lesser General Public License 2.1 we say", "lgpl"),
        8: ("It is Licensed under CC BY-SA 4.0", "cc-by-sa"), 9: ("redistribution and use in source or binary forms, with or without modification, are permitted", "bsd")}
    docs = spark.createDataFrame([(i, f"one\n{t}\nlast") for i, (t, _) in lines.items()], "doc_id long, text string").selectExpr("*", "1 AS paragraph", "'x' AS family")
    rows = L.scan(docs, classifier).collect()
    assert {r.doc_id: r.family for r in rows if r.confirmed} == {i: f for i, (_, f) in lines.items()}
    assert {r.paragraph for r in rows} == {1}
    clean = spark.createDataFrame([(1, "the new license plate of the software"), (2, "the mit campus"), (3, "no word"), (4, None), (5, ""), (None, "All rights reserved"),
                                   (6, "your rights were reserved by nobody")] + [(7, "All rights reserved\nAll rights reserved")] * 2, "doc_id long, text string")
    rows = L.scan(clean, classifier).where("confirmed").collect()
    assert sorted((r.doc_id or 0, r.paragraph) for r in rows) == [(0, 0), (7, 0), (7, 1)]
    assert L.scan(clean.limit(0), classifier).count() == 0


def test_scores_equal_a_loop_over_the_weights(spark, classifier):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike("(?i)licen|rights|free|public"))
    table = {r.term: (r.weight, r.sentences) for r in classifier.terms.collect()}
    want = {}
    for d in docs.collect():
        for n, line in enumerate(d.text.split("\n")):
            w = "".join(c if c.isascii() and c.isalnum() else " " for c in line.lower()).split()
            terms = {" ".join(w[i:i + k]) for k in (2, 3) for i in range(len(w) - k + 1)} & set(table)
            if not terms:
                continue
            s = [(b + sum(table[t][0][k] for t in terms)) / classifier.temperature for k, b in enumerate(classifier.intercepts)]
            e = [math.exp(x) for x in s]
            k = max(range(len(e)), key=e.__getitem__)
            if classifier.families[k] != L.UNKNOWN:
                held = [x for t in terms for x in table[t][1]]
                alike = max([held.count(i) / size for i, (f, size) in enumerate(zip(classifier.sentence_family, classifier.sentence_terms)) if f == classifier.families[k]])
                want[(d.doc_id, n)] = (classifier.families[k], round(e[k] / sum(e), 6), round(alike, 6))
    got = {(r.doc_id, r.paragraph): (r.family, round(r.probability, 6), round(r.similarity, 6)) for r in L.scan(docs, classifier).collect()}
    assert got == want and len(want) > 20

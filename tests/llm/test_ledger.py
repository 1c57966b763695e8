import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from telerisk.llm import ledger

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


@pytest.mark.parametrize("source", ["edge", "documents"])
def test_measurements_equal_brute_force(spark, source):
    if source == "edge":
        texts = [None, "", " ", "a", "\n\n", "x\ny\nx\n", "a b c d e a b c d e", "a a a a a a", "é # ñ\r\n<|>\v\fq", "w " * 5000, "same", "same",
                 "\nx\n x\nx", "u v", "end\n"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    else:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = ledger.apply_policy(ledger.ledger(docs)).collect()
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], r
        assert not (r.base_failed and r.kept)


def test_policies_and_ablations(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "few"), (3, "a " * 30), (4, "# " * 30), (None, None)],
                                 "doc_id long, text string")
    entries = ledger.ledger(docs)
    kept = {r.doc_id: r.kept for r in ledger.apply_policy(entries).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, None: False}
    counts = {r.rule: (r.n_failed, r.n_only) for r in ledger.ablations(entries).collect()}
    assert counts["few_words"] == (2, 2) and counts["repeated_words"] == (2, 0)
    assert ledger.ablations(ledger.ledger(docs.limit(0))).count() == 0

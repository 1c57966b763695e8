import random

import pytest

from telerisk.llm import tokens as T
from telerisk.llm.queries import VOCABULARY


def brute(text, sections, rule):
    """Token counts of each section by a loop over tokens and characters."""
    encoder, _ = T.encoding(VOCABULARY, T.PATTERN)
    owner = [len(text[:i].encode()) for i in range(len(text) + 1)]
    of_byte = {b: i for i in range(len(text)) for b in range(owner[i], owner[i + 1])}
    out, at, outside = [0.0] * len(sections), 0, 0
    ids = encoder.encode_ordinary(text)
    for t in ids:
        raw = encoder.decode_single_token_bytes(t)
        begin, end = of_byte[at], of_byte[at + len(raw) - 1] + 1
        at += len(raw)
        share = [max(0, min(end, b) - max(begin, a)) for a, b in sections]
        if not sum(share):
            outside += 1
        elif rule == "first":
            out[next(i for i, s in enumerate(share) if s)] += 1
        elif rule == "largest":
            out[share.index(max(share))] += 1
        else:
            out = [x + s / sum(share) for x, s in zip(out, share)]
    assert at == len(text.encode())
    return len(ids), out, outside


def line_sections(text):
    out, at = [], 0
    for x in text.split("\n"):
        out.append((at, at + len(x) + 1))
        at += len(x) + 1
    out[-1] = (out[-1][0], len(text))
    return [s for s in out if s[1] > s[0]]


@pytest.mark.parametrize("rule", T.RULES)
def test_lines_equal_brute_force(spark, rule):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    texts += ["\n\n\n a \n\n\n", "é\n\nñ😀😀\n", "x" * 40000, "a\r\n\r\nb  \n  c", "\n", "tail\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS sections", "2 AS n_tokens")
    rows = T.attribute(docs, VOCABULARY, rule).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, want, outside = brute(r.row.text, line_sections(r.row.text), rule)
        assert (r.n_tokens, r.n_chars, r.n_outside) == (n, len(r.row.text), outside)
        assert [s.tokens for s in r.sections] == pytest.approx(want) and [(s.start, s.end) for s in r.sections] == line_sections(r.row.text)
        assert sum(s.tokens for s in r.sections) + r.n_outside == pytest.approx(r.n_tokens)


@pytest.mark.parametrize("rule", T.RULES)
def test_given_sections_with_gaps(spark, rule):
    rng = random.Random(2)
    data = []
    for i in range(30):
        text = "".join(rng.choice(["the ", "and", "é", "tion", "\n", " un", "1"]) for _ in range(rng.randrange(1, 60)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(0, 5))))
        data.append((i, text, list(zip(cuts[::2], cuts[1::2]))))
    docs = spark.createDataFrame(data, "doc_id long, text string, fields array<struct<start:long,end:long>>")
    for r in T.attribute(docs, VOCABULARY, rule, "fields").collect():
        n, want, outside = brute(r.row.text, [(s.start, s.end) for s in r.row.fields], rule)
        assert r.n_outside == outside and [s.tokens for s in r.sections] == pytest.approx(want)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = T.attribute(docs, VOCABULARY).collect()
    assert sorted((r.n_tokens, len(r.sections)) for r in rows) == [(0, 0), (0, 0), (1, 1), (1, 1)]
    assert T.attribute(docs.limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        T.attribute(docs, VOCABULARY, "none")

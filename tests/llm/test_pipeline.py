import re

import corpus_pipeline
from test_credentials import brute as brute_spans
from test_simhash import brute_components, brute_fp

from telerisk.llm import credentials, simhash, toxicity

SF = "/root/testdata/sf0.001"


def secrets_out(text):
    out, at = "", 0
    for start, _, _, end in brute_spans(text):
        if start >= at:
            out += text[at:start] + "[REDACTED]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").select("row.doc_id").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id not in toxic}
    ids = sorted(rows)
    groups = brute_components(ids, [brute_fp(rows[i].text) for i in ids])
    ids = [i for i, c in zip(ids, groups) if i == c]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = [i for i in ids if not any(b in rows[i].text for b in bench)]
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == ids
    weak = re.compile(r"://|user|login")
    for r in found:
        if not weak.search(rows[r.doc_id].text):
            assert r.text == secrets_out(rows[r.doc_id].text)
        assert r.n_chars == len(r.text) and (r.source, r.lang) == (rows[r.doc_id].source, rows[r.doc_id].lang)
    assert len({(r.mix_slot, r.mix_place) for r in found}) == len(found)
    assert len(ids) > 100


def test_representatives_and_redaction_keep_rows_apart(spark):
    data = [(1, "password=abcdefgh one", "a"), (1, "password=abcdefgh one", "a"), (1, "other token=12345678 text", "b"), (2, "PASSWORD=abcdefgh one", "c"),
            (None, "x y z é 😀 secret=abcdefghi\nend", "d"), (None, None, "e"), (3, "", "f"), (None, "x y z é 😀 secret=abcdefghi\nend", "g")]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.representatives(docs).collect())
    assert kept == [(0, data[4][1]), (1, data[2][1]), (1, data[0][1]), (3, "")]
    texts = sorted((r.fp, r.text) for r in credentials.redact(docs).collect())
    assert texts == [("a", "[REDACTED] one")] * 2 + [("b", "other [REDACTED] text"), ("c", "[REDACTED] one"), ("d", "x y z é 😀 [REDACTED]\nend"),
                                                     ("e", None), ("f", ""), ("g", "x y z é 😀 [REDACTED]\nend")]
    assert simhash.representatives(docs.limit(0)).count() == 0 and credentials.redact(docs.limit(0)).count() == 0

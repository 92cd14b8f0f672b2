"""The pipeline's stages on the smallest tables and on a messy fixture."""

import corpus_pipeline as C

from veritide.llm import secrets
from veritide.llm.shared import read, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents").select(*C.COLUMNS)
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == list(C.COLUMNS)
            now = [r.doc_id for r in docs.collect()]
            assert len(now) == len(set(now)) and set(now) <= kept
            kept = set(now)
        if name == "secrets":
            assert not any(secrets.scan(r.text) for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} == kept and len(kept) > 100


def test_messy(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "password=abcdefgh1", None, None, 18), (None, "some plain words that stay here", "en", None, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[1:]:
        docs = written(stage(spark, docs, SF), "test-messy")
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, None}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        empty = written(stage(spark, empty, SF), "test-empty")
    assert empty.count() == 0

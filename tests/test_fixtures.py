"""Hand-derived cases of the reference's formulas."""

import datetime

from pyspark.sql import functions as F
from pytest import approx

from veritide.functions import text as T
from veritide.operators import retrieval as R
from veritide.operators import scoring as S
from veritide.operators import source_quality as Q
from veritide.operators.attribution import attribute
from veritide.sources.files import padded_rubric, pick_csv


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tokenizers(spark):
    r = one(spark, T.words(F.lit("Èa b_1, The")), T.metric_words(F.lit("The cat cat is on")), T.keywords(F.lit("With .... learning, ok")))
    assert r[0] == ["èa", "b_1", "the"]
    assert r[1] == ["cat", "cat"]
    assert r[2] == ["", "learning"]


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit("A b. C d!  E")))[0] == ["A b.", "C d!", "E"]


def test_tier_and_thresholds(spark):
    score = [one(spark, S.threshold_score(F.lit(v), [1, 3, 6, 10]))[0] for v in (0, 1, 3, 6, 10)]
    assert score == [1, 2, 3, 4, 5]
    assert [one(spark, S.recency_score(F.lit(v), [30, 90, 180, 365]))[0] for v in (30, 31, 181, 366)] == [5, 4, 2, 1]
    assert one(spark, S.tier_quality(F.lit(5 / 3)))[0] == 0.1


def test_dynamic_k(spark):
    k = lambda kind, q, n: one(spark, S.dynamic_k(F.lit(kind), F.lit(q), F.lit("x" * n)))[0]
    assert (k("rubric", "", 501), k("rubric", "", 201), k("rubric", "", 9)) == (10, 8, 6)
    assert (k("quant", "count of", 0), k("quant", "", 0), k("recency", "", 0)) == (8, 6, 12)


def test_rrf(spark):
    lists = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 2), (1, "b", 2, 1), (1, "c", 2, 2)], "q int, id string, list_no int, rank int")
    got = [(r.id, r.score) for r in R.rrf(lists).orderBy("rank").collect()]
    assert got == [("b", approx(1 / 62 + 1 / 61, abs=1e-7)), ("a", approx(1 / 61, abs=1e-7)), ("c", approx(1 / 62, abs=1e-7))]


def test_ir_metrics(spark):
    gold = spark.createDataFrame([(1, "x", 3.0), (1, "y", 1.0)], "q int, id string, relevance double")
    found = spark.createDataFrame([(1, "z", 1), (1, "x", 2), (2, "z", 1)], "q int, id string, rank int")
    got = {r.q: (r.hit_rate, r.mrr, r.ndcg) for r in R.ir_metrics(found, gold).collect()}
    assert got == {1: (0.5, 0.5, 0.5213), 2: (None, None, None)}


def test_where_matcher(spark):
    df = spark.createDataFrame([(1, "a"), (3, None)], "tier int, s string")
    assert df.where(R.where_matcher({"$or": [{"tier": {"$eq": 1}}]})).count() == 1
    assert df.where(R.where_matcher({"tier": {"$gt": 0}})).count() == 0


def test_dates(spark):
    dates = lambda s, *a: sorted(one(spark, Q.extract_dates(F.lit(s), *a))[0])
    d = datetime.date
    assert dates("15 January 2025") == [d(2025, 1, 15)] * 2
    assert dates("3 March 2024") == [d(2024, 3, 3), d(2024, 3, 15)]
    assert dates("2025-02-30") == []
    assert dates("March 2024", 1, False) == [d(2024, 3, 1)]


def test_freshness(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    at = lambda days: one(spark, Q.freshness(F.lit("2024-06-01").cast("timestamp") - F.make_dt_interval(F.lit(days)), now))[0]
    assert (at(0), at(730), at(5000)) == (1.0, 0.1, 0.1)
    assert one(spark, Q.freshness(F.lit(None).cast("timestamp"), now))[0] == 0.3


def test_authority(spark):
    a = lambda url: one(spark, Q.authority(F.lit(url), F.lit("x"), "orange.com"))[0]
    assert a("https://news.reuters.com/a")[:2] == ("third_party_news", 0.8)
    assert a("https://x.orange.com/a")[:2] == ("first_party", 0.5)
    boost = [one(spark, Q.authority_boost(F.lit(f), F.lit(t)))[0] for f, t in ((True, True), (False, True), (True, False), (False, False))]
    assert boost == [0.15, 0.105, 0.03, 0.0]


def test_contradictions_and_independence(spark):
    df = spark.createDataFrame([(1, 1, "mature platform"), (1, 2, "a pilot only"), (2, 3, "same words here again"), (2, 4, "same words here again")], "grp int, source_id int, text string")
    assert Q.contradictions(df, (("(mature|proven)", "(pilot|prototype)"),)).count() == 1
    assert [(r.a, r.b) for r in Q.token_overlap(df).collect()] == [(3, 4)]


def test_attribution(spark):
    rows = [("a", 1, 3.0, "m", "p", "d"), ("a", 2, 3.2, "n", "p", "d"), ("a", 3, 3.5, "n", "p", "d"), ("a", 4, 4.0, "o", "p", "d")]
    df = spark.createDataFrame(rows, "k string, r int, s double, model string, prompt string, data string")
    got = attribute(df, ["k"], "r", "s", (("model", "model_change"), ("prompt", "prompt_change"))).orderBy("r").collect()
    assert [r.cause for r in got] == [None, None, "external_noise", "model_change"]


def test_chunks(spark):
    text = "A sentence of words. " * 120 + "w " * 700
    docs = spark.createDataFrame([(1, " "), (2, "One short sentence."), (3, text)], "id int, text string")
    got = R.chunks(docs, "id", "text").collect()
    assert not [r for r in got if r.id == 1]
    assert [r.chunk for r in got if r.id == 2] == ["One short sentence."]
    assert all(len(r.chunk) <= 1200 for r in got)
    assert [r.chunk_no for r in got if r.id == 3] == list(range(len([r for r in got if r.id == 3])))


def test_small_helpers(spark):
    assert pick_csv(["b.csv", "my_kpi.csv", "a.csv"]) == "my_kpi.csv" and pick_csv([]) is None
    assert one(spark, padded_rubric(F.array(F.lit("1: x"))))[0][1] == "2: (no criteria defined)"
    assert one(spark, S.score5_text(F.array(F.lit("1: a"), F.lit(" 5: best ")))).asDict().popitem()[1] == "best"


def test_streaming_attribution(spark, tmp_path):
    from veritide.streaming.attribution import attribute_stream

    rows = [("a", 1, 3.0, "m", "p", "d"), ("a", 2, 3.6, "n", "p", "d")]
    spark.createDataFrame(rows, "key string, run_no long, score double, model string, prompt string, data string").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, run_no long, score double, model string, prompt string, data string").parquet(str(tmp_path / "in"))
    q = attribute_stream(src).writeStream.format("memory").queryName("attributed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.run_no, r.cause) for r in spark.table("attributed").orderBy("run_no").collect()] == [(1, None), (2, "model_change")]


def test_ddl_and_log(spark):
    from veritide.operators.sinks import apply_ddl

    assert apply_ddl(spark, "-- a comment\nCREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS x;\nSELECT * FROM one;") == 2

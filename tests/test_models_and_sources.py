"""Injected models and their defaults, and readers and writers of files, on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from veritide.operators import models as M
from veritide.operators import retrieval as R
from veritide.operators import scoring as S
from veritide.operators import sinks
from veritide.operators import source_quality as Q
from veritide.sources import files


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_judge(spark):
    df = spark.createDataFrame([(1, "q", "a", ["c"]), (2, "q", None, [])], "k int, question string, answer string, contexts array<string>")
    for r in rows_of(M.judged(df)):
        assert (r["overall"], r["feedback"], r["llm_used"]) == (None, "LLM judge unavailable.", False)

    def judge(d):
        ok = F.col("answer").isNotNull()
        return d.select("*", F.when(ok, 4).alias("correctness"), F.lit(None).cast("int").alias("completeness"), F.when(ok, 5).alias("clarity"), F.when(ok, 4).alias("overall"), F.when(ok, "fine").alias("feedback"))

    got = {r["k"]: r for r in rows_of(M.judged(df, judge))}
    assert (got[1]["correctness"], got[1]["completeness"], got[1]["feedback"], got[1]["llm_used"]) == (4, 3, "fine", True)
    assert (got[2]["overall"], got[2]["llm_used"]) == (None, False)


def test_chain_of_thought_and_grounding(spark):
    df = spark.createDataFrame([("r", ["x" * 900, "y", "z", "w"]), ("", ["x"]), (None, [])], "rationale string, chunks array<string>")
    assert all(r["cot_evidence"] is None and not r["weak_reasoning"] for r in rows_of(M.chain_of_thought(df)))
    scorer = lambda d: d.select("*", F.lit(9).alias("cot_specificity"), F.lit(2).alias("cot_evidence"), F.lit(3).alias("cot_alignment"))
    got = rows_of(M.chain_of_thought(df, scorer))
    assert (got[0]["cot_specificity"], got[0]["weak_reasoning"]) == (5, True) and got[1]["cot_alignment"] is None and not got[1]["weak_reasoning"]
    f1 = lambda d: d.withColumn("bertscore_f1", F.char_length("reference") / 1208.0)
    assert [(r["bertscore_f1"], r["low_semantic_grounding"]) for r in rows_of(M.grounded(df, f1))] == [(0.6656, True), (None, False), (None, False)]
    assert all(r["bertscore_f1"] is None and not r["low_semantic_grounding"] for r in rows_of(M.grounded(df)))


def test_repeated_scores(spark):
    df = spark.createDataFrame([("alpha beta gamma delta", "alpha beta words"), (None, "text here")], "rubric string, evidence string")
    got = rows_of(M.repeated_scores(df, runs=3))
    assert (got[0]["raw_scores"], got[0]["mean"], got[0]["std"], got[0]["successful_runs"]) == ([5.0] * 3, 5.0, 0.0, 0) and got[1]["mean"] == 3.0
    scorer = lambda d: d.withColumn("score", F.when(F.col("run") != 1, F.col("run") + 2.0))
    got = rows_of(M.repeated_scores(df, scorer, 3))[0]
    assert (got["raw_scores"], got["mean"], got["std"], got["successful_runs"]) == ([2.0, 4.0], 3.0, 1.4142, 2)


def test_embedder_and_contradictions(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in rows_of(M.embedded(df, dims=16))}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and got[2] == [0.0] * 16 == got[3]
    from veritide.functions import text as T

    for r in R.sparse_embedding(df.where("id = 1"), "id", T.words(F.col("text")), 16).collect():
        assert got[1][r.bucket] == pytest.approx(r.weight, abs=1e-6)
    own = M.embedded(df, embedder=lambda d: d.withColumn("embedding", F.array(F.lit(1.0))))
    assert {tuple(r["embedding"]) for r in rows_of(own)} == {(1.0,)}
    pairs = spark.createDataFrame([("up", "down"), ("up", "up")], "claim_a string, claim_b string")
    assert M.contradicting(pairs).count() == 0
    assert M.contradicting(pairs, lambda d: d.withColumn("contradicts", F.col("claim_a") != F.col("claim_b"))).count() == 1
    sources = spark.createDataFrame([(1, 1, "A large team and mature tools."), (1, 2, "Only a SMALL team, an experimental one.")], "grp int, source_id int, text string")
    found = {(r.a, r.b, r.claim_a, r.claim_b) for r in Q.contradictions(sources).collect()}
    assert found == {(1, 2, "large team", "small team"), (1, 2, "mature", "experimental")}


def test_rerank_and_hybrid(spark):
    found = spark.createDataFrame([(q, i, 1.0 / i, i) for q, n in ((1, 2), (2, 5)) for i in range(1, n + 1)], "q int, id int, score double, rank int")
    order = lambda df: [(r.q, r.id) for r in df.orderBy("q", "rank").collect()]
    assert order(R.rerank(found)) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    cross = lambda d: d.withColumn("relevance", F.when(F.col("id") != 4, F.col("id").cast("double")))
    assert order(R.rerank(found, 3, cross))[2:] == [(2, 5), (2, 3), (2, 2)]
    asked = spark.createDataFrame([(1, "what"), (2, "  ")], "q int, text string")
    lexical = found.select("q", (F.col("id") + 10).alias("id"), "score", "rank")
    assert order(R.hybrid(found, lexical, asked, 2)) == [(1, 1), (1, 11), (1, 2), (1, 12)]
    assert order(R.hybrid(found, lexical, asked, 1, "semantic")) == [(1, 1)]
    with pytest.raises(ValueError, match="mode"):
        R.hybrid(found, lexical, asked, 1, "other")


def test_bm25_postings(spark):
    df = spark.createDataFrame([(1, "b a b c."), (2, None), (3, "")], "id int, text string")
    got = {(r.id, r.token): (r.tf, r.dl) for r in R.postings(df, "id", "text").collect()}
    assert got == {(1, "a"): (1, 4), (1, "b"): (2, 4), (1, "c"): (1, 4)}


def test_claims_in_order(spark):
    say = "We deploy the automation platform for customers in region"
    text = ". ".join([f"{say} {i}" for i in range(40)] + [f"{say} 3 with more words behind sixty characters", "short ai"]) + "."
    got = Q.extract_claims(spark.createDataFrame([(1, text), (2, "Accept the cookie policy of this automation platform."), (3, None)], "id int, text string"), "id", "text").collect()
    assert {r.source_id for r in got} == {1} and [r.pos for r in got] == list(range(30))


def test_scoring_fallbacks(spark):
    df = spark.createDataFrame([("alpha beta gamma", "alpha and more"), (None, "strong growth with quality"), (None, "risk issue problem weak"), (None, None)], "ideal string, blob string")
    score, sure = S.rubric_fallback(F.col("ideal"), F.col("blob"))
    assert [tuple(r) for r in df.select(score, sure).collect()] == [(4, 0.6), (5, 0.4), (1, 0.4), (3, 0.2)]
    rubric = F.array(F.lit("1: bad"), F.lit("5: all good "))
    prompt = spark.range(1).select(S.rubric_prompt(F.lit("n"), F.lit("q"), rubric, F.lit("- [1] u: t"))).first()[0]
    assert prompt.endswith('KPI: n\nQuestion: q\nRubric:\n1: bad\n5: all good \n\nIdeal (5 = High): "all good"\nScore how close the evidence supports this level (1 = not at all, 5 = fully).\nEvidence:\n- [1] u: t\n')


def test_yaml_catalog_and_reports(spark, tmp_path):
    (tmp_path / "k.yaml").write_text("- kpi_id: a\n  name: A\n  rubric: ['1: x', '5: y']\n- kpi_id: b\n  thresholds: [1, 2.5]\n")
    kpis = files.scan_kpi_yaml(spark, f"file://{tmp_path}/k.yaml")
    got = {r.kpi_id: r for r in kpis.collect()}
    assert got["a"].rubric == ["1: x", "5: y"] and got["b"].thresholds == [1.0, 2.5] and got["b"].name is None
    assert files.kpi_catalog(kpis.limit(0), kpis) is kpis and files.kpi_catalog(kpis, None) is kpis
    out = f"file://{tmp_path}/reports"
    df = spark.createDataFrame([("r1", "2024-01-02", "é", 1.5, [("k", 2.0)]), ("r2", "2024-02-01", None, None, [])], "run_id string, timestamp string, company string, overall_score double, kpis array<struct<kpi_id:string,score:double>>")
    sinks.write_yaml(df, out, "run_id")
    sinks.write_yaml(df, out, "run_id")  # again: the same files
    assert sorted(p.name for p in (tmp_path / "reports").iterdir()) == ["report_r1.yaml", "report_r2.yaml"]
    assert (tmp_path / "reports/report_r1.yaml").read_text() == "run_id: r1\ntimestamp: '2024-01-02'\ncompany: é\noverall_score: 1.5\nkpis:\n- kpi_id: k\n  score: 2.0\n"
    assert [(r["rank"], r.run_id, r.company) for r in files.scan_reports(spark, out).orderBy("rank").collect()] == [(1, "r2", None), (2, "r1", "é")]


def test_exports_and_folders(spark, tmp_path):
    for d in ("b", "a", "none"):
        (tmp_path / d).mkdir()
    for name, urls in (("a/Acme X_sources_export.json", ["u1", "", None, "u2"]), ("a/Acme_sources_export.json", ["v"]), ("b/Other_sources_export.json", [])):
        (tmp_path / name).write_text(json.dumps([{"url": u} for u in urls], indent=1))
    assert files.company_folders(spark, f"file://{tmp_path}") == ["a", "b"]
    got = lambda c, cap=None: [r.url for r in files.urls_from_export(spark, f"file://{tmp_path}/a", c, cap).collect()]
    assert got("Acme") == ["u1", "u2"] and got("Acme", 1) == ["u1"] and got("Nobody") == [] and got("Acme_") == ["v"]
    (tmp_path / "t.csv").write_text("a,b\n01,x\n")
    assert files.scan_text_csv(spark, f"file://{tmp_path}/t.csv").first().a == "01"


def test_flags_and_golden_source(spark):
    assert files.feature_flags({}) == files.Flags() and files.feature_flags({"VERITIDE_N_SCORING_RUNS": "x"}).n_scoring_runs == 5
    flags = files.feature_flags({"VERITIDE_N_SCORING_RUNS": "2", "VERITIDE_SCORING_TEMPERATURE": "0.1", "VERITIDE_BERTSCORE_DISABLED": "TRUE", "VERITIDE_COT_EVAL_DISABLED": "0"})
    assert flags == files.Flags(2, 0.1, False, True)
    db, yaml = (spark.createDataFrame([(n,)], "n string") for n in ("db", "yaml"))
    of = lambda name: sorted(r.n for r in files.golden_source(name, db, yaml, lambda y, d: y.union(d)).collect())
    assert (of(None), of(" YAML "), of("both"), of("odd")) == (["db"], ["yaml"], ["db", "yaml"], ["db"])


def test_load_run(spark):
    runs = spark.createDataFrame([(7, "A" * 32, 1), (8, None, 2)], "id int, run_uuid string, company_id int")
    companies = spark.createDataFrame([(1, "Acme"), (2, "Other")], "id int, name string")
    uuid = "-".join(("a" * 8, "a" * 4, "a" * 4, "a" * 4, "a" * 12))
    scores = spark.createDataFrame([(1, uuid, "k"), (2, uuid, "not mine"), (1, None, "no run")], "company_id int, run_uuid string, kpi_id string")
    sources = spark.createDataFrame([(7, "s"), (8, "t")], "run_id int, source_id string")
    got = files.load_run(runs, scores, sources, companies, "7")
    assert [(r.kpi_id, r.company) for r in got[0].collect()] == [("k", "Acme")] and [(r.source_id, r.company) for r in got[1].collect()] == [("s", "Acme")]
    assert files.load_run(runs, scores, sources, companies, "A" * 32)[0].count() == 1
    assert files.load_run(runs, scores, sources, companies, "99") is None
    assert files.load_run(runs, scores, sources, companies, "8")[0].count() == 0


def test_trace_events(spark):
    df = spark.createDataFrame([("t1", 0.2, None), ("t2", None, "step")], "trace string, f1 double, span string")
    got = {tuple(r) for r in sinks.trace_events(df, "trace", F.lit(1), ["f1"], {"low": F.col("f1") < 0.5}, ["span"]).collect()}
    assert got == {("t1", "score", "f1", "0.2", 1), ("t1", "event", "low", "true", 1), ("t2", "span", "span", "step", 1)}
    with pytest.raises(ValueError, match="nothing"):
        sinks.trace_events(df, "trace", F.lit(1))

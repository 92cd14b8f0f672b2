"""Queries of KPI scoring, gates and report rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritide.functions.numbers import even
from veritide.functions import text as T
from veritide.operators import scoring as S
from veritide.plans.base import query, t56

RUB = "list_value('1: none', ' 5: ' || b.text || ' ', '3: some')"
PAIR = "documents d LEFT JOIN items b ON b.r = d.doc_id % b.n"


def paired(t):
    """Documents with the rubric made of a benchmark item."""
    b = t("items").select("r", "n", F.array(F.lit("1: none"), F.concat(F.lit(" 5: "), "text", F.lit(" ")), F.lit("3: some")).alias("rubric"))
    return t("documents").join(b, F.col("r") == F.col("doc_id") % F.col("n"), "left")


query("score5_text", f"SELECT d.doc_id, trim(substr(list_filter(list_transform({RUB}, lambda s: trim(s)), lambda s: starts_with(s, '5:'))[1], 3)) AS ideal FROM {PAIR}")(
    lambda t: paired(t).select("doc_id", S.score5_text(F.col("rubric")).alias("ideal"))
)
_OV = f"len(list_intersect({t56('b.text', 3)}, {t56('d.text', 3)}))::DOUBLE / greatest(1, len({t56('b.text', 3)}))"
_BAND = "CASE WHEN ov >= 0.35 THEN 5 WHEN ov >= 0.22 THEN 4 WHEN ov >= 0.12 THEN 3 WHEN ov >= 0.05 THEN 2 ELSE 1 END"


def _overlap(t, least):
    ideal = T.long_words(S.score5_text(F.col("rubric")), least)
    return paired(t).select("doc_id", T.overlap(ideal, T.long_words(F.col("text"), least)).alias("ov"))


@query("fallback_rubric", f"WITH o AS (SELECT d.doc_id, {_OV} AS ov FROM {PAIR}) SELECT doc_id, {_BAND} AS score, round_even(0.35::DOUBLE + least(0.25::DOUBLE, ov), 2) AS confidence FROM o")
def _(t):
    return _overlap(t, 3).select("doc_id", S.band_score(F.col("ov")).alias("score"), even(0.35 + F.least(F.lit(0.25), F.col("ov")), 2).alias("confidence"))


@query("prompt_heuristic", f"WITH o AS (SELECT d.doc_id, {_OV.replace('>= 3', '>= 4')} AS ov FROM {PAIR}) SELECT doc_id, CAST({_BAND} AS DOUBLE) AS score FROM o")
def _(t):
    return _overlap(t, 4).select("doc_id", S.band_score(F.col("ov")).cast("double").alias("score"))


query(
    "hint_score",
    "SELECT doc_id, least(5, greatest(1, 3 " + "".join(f" + CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in S.POSITIVE) + "".join(f" - CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in S.NEGATIVE) + ")) AS score FROM documents",
)(lambda t: t("documents").select("doc_id", S.hint_score(F.lower("text")).alias("score")))
MENTIONS = ("tion", "ti", "the", "keit")
_COUNT = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in MENTIONS)
query("count_mentions", f"SELECT doc_id, {_COUNT} AS n FROM documents")(lambda t: t("documents").select("doc_id", S.count_mentions(F.col("text"), MENTIONS).alias("n")))
query("threshold_score", f"WITH c AS (SELECT doc_id, {_COUNT} AS n FROM documents) SELECT doc_id, CASE WHEN n < 20 THEN 1 WHEN n < 60 THEN 2 WHEN n < 100 THEN 3 WHEN n < 200 THEN 4 ELSE 5 END AS score FROM c")(
    lambda t: t("documents").select("doc_id", S.threshold_score(S.count_mentions(F.col("text"), MENTIONS), [20, 60, 100, 200]).alias("score"))
)
AGE = "CAST(floor(date_diff('second', o_orderdate, TIMESTAMP '1998-12-01') / 86400.0) AS BIGINT)"


def age(t):
    return F.floor((F.unix_timestamp(F.lit("1998-12-01").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400)


query("recency_score", f"WITH a AS (SELECT o_custkey, min({AGE}) AS d FROM orders GROUP BY 1) SELECT o_custkey, d AS days, CASE WHEN d <= 30 THEN 5 WHEN d <= 90 THEN 4 WHEN d <= 180 THEN 3 WHEN d <= 365 THEN 2 ELSE 1 END AS score FROM a")(
    lambda t: t("orders").groupBy("o_custkey").agg(F.min(age(t)).alias("days")).select("o_custkey", "days", S.recency_score(F.col("days"), [30, 90, 180, 365]).alias("score"))
)
query(
    "quant_kpi",
    f"WITH c AS (SELECT source, sum({_COUNT}) AS n FROM documents GROUP BY source) SELECT source, CAST(n AS BIGINT) AS n, CASE WHEN n < 2000 THEN 1 WHEN n < 4000 THEN 2 WHEN n < 6000 THEN 3 WHEN n < 8000 THEN 4 ELSE 5 END AS score, CASE WHEN n > 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM c",
)(
    lambda t: t("documents").groupBy("source").agg(F.sum(S.count_mentions(F.col("text"), MENTIONS)).alias("n"))
    .select("source", "n", S.threshold_score(F.col("n"), [2000, 4000, 6000, 8000]).alias("score"), F.when(F.col("n") > 0, 0.7).otherwise(0.3).alias("confidence"))
)
AGG = """a AS (SELECT company, run_no, kpi_id, count(*) AS chunks, count(DISTINCT source_id) AS sources, avg(tier) AS tier, max(value) AS v, bool_or(tier = 1) AS cited FROM cites GROUP BY 1, 2, 3),
    r AS (SELECT k.company, k.run_no, k.kpi_id, confidence, chunks, sources, cited, round_even(greatest(0, 0.15::DOUBLE - (tier - 1) * 0.15::DOUBLE / 2), 3) AS tb, (k.n % 5) / 5.0 AS corr FROM kr k JOIN a ON a.company = k.company AND a.run_no = k.run_no AND a.kpi_id = k.kpi_id)"""


def evidence(t):
    keys = ["company", "run_no", "kpi_id"]
    a = t("cites").groupBy(*keys).agg(F.count("*").alias("chunks"), F.countDistinct("source_id").alias("sources"), S.tier_quality(F.avg("tier")).alias("tb"), F.bool_or(F.col("tier") == 1).alias("cited"))
    return t("kr").join(a, keys).withColumn("corr", (F.col("n") % 5) / 5.0)


query("score_split", "SELECT company, kpi_id, round_even(avg(score) FILTER (WHERE run_no < 2), 4) AS baseline, round_even(avg(score) FILTER (WHERE run_no >= 2), 4) AS live, round_even(avg(score) FILTER (WHERE run_no >= 2) - avg(score) FILTER (WHERE run_no < 2), 4) AS delta FROM kr GROUP BY 1, 2")(
    lambda t: t("kr").groupBy("company", "kpi_id").agg(F.avg(F.when(F.col("run_no") < 2, F.col("score"))).alias("b"), F.avg(F.when(F.col("run_no") >= 2, F.col("score"))).alias("l"))
    .select("company", "kpi_id", even("b", 4).alias("baseline"), even("l", 4).alias("live"), even(F.col("l") - F.col("b"), 4).alias("delta"))
)
GATE = r"""g AS (SELECT company, kpi_id, avg(score) AS m, stddev_samp(score) AS sd, CASE WHEN count(*) > 2 THEN avg(confidence) END AS f FROM kr GROUP BY 1, 2),
    p AS (SELECT company, kpi_id, count(*) FILTER (WHERE tier = 1) AS p, count(*) AS n, bool_or(tier = 3 AND regexp_extract(url, '[.](d\d+)[.]', 1) <> concat('d', company % 7)) AS bleed FROM cites GROUP BY 1, 2)"""


@query(
    "quality_gates",
    f"""WITH {GATE} SELECT g.company, g.kpi_id, coalesce(f < 0.8, false) OR bleed AS blocked, f >= 0.8 AS faithful, sd <= 0.4 AS stable, CASE WHEN sd > 0.4 THEN concat(round_even(m - sd, 2), '–', round_even(m + sd, 2)) END AS score_range,
        p::DOUBLE / n < 0.4 AS suppress, bleed FROM g JOIN p ON g.company = p.company AND g.kpi_id = p.kpi_id""",
)
def _(t):
    """Confidence stands for faithfulness, unknown for KPIs of few runs; a tier 3 source of another company's host is foreign."""
    k = ["company", "kpi_id"]
    g = t("kr").groupBy(*k).agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"), F.when(F.count("*") > 2, F.avg("confidence")).alias("f"))
    other = F.regexp_extract("url", r"[.](d\d+)[.]", 1) != F.concat(F.lit("d"), (F.col("company") % 7).cast("string"))
    p = t("cites").groupBy(*k).agg(F.count_if(F.col("tier") == 1).alias("p"), F.count("*").alias("n"), F.bool_or((F.col("tier") == 3) & other).alias("foreign"))
    return g.join(p, k).select(*k, S.gates(F.col("f"), F.col("m"), F.col("sd"), F.col("p"), F.col("n"), F.col("foreign")).alias("g")).select(*k, "g.*")


_HAS = lambda words: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words)
query("legacy_score", f"SELECT doc_id, least(100, greatest(0, 60 + 5 * ({_HAS(S.POSITIVE)}) - 5 * ({_HAS(S.NEGATIVE)}))) AS score FROM documents")(
    lambda t: t("documents").select("doc_id", S.legacy_score(F.lower("text")).alias("score"))
)


ISSUES = (("Low Confidence", "confidence < 0.5"), ("Poor Source Quality", "avg_tier > 2.5"), ("Low Corroboration", "corr < 0.3 AND sources > 1"), ("Single Source", "sources <= 1"), ("Missing Citations", "NOT cited"))
IMP = f"WITH {AGG.replace('confidence, chunks,', 'confidence, a.tier AS avg_tier, chunks,')}, i AS (" + " UNION ALL ".join(f"SELECT company, run_no, kpi_id, '{n}' AS issue FROM r WHERE {c}" for n, c in ISSUES) + ")"


def issues(t):
    keys = ["company", "run_no", "kpi_id"]
    e = evidence(t).join(t("cites").groupBy(*keys).agg(F.avg("tier").alias("avg_tier")), keys)
    found = F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in ISSUES)))
    return e.select(*keys, F.explode(found).alias("issue"))


query("improvements", f"{IMP} SELECT company, run_no, kpi_id, issue FROM i")(issues)
query("report_text", f"{IMP} SELECT issue, count(*) AS n, list(concat(company, ':', run_no, ':', kpi_id) ORDER BY company, run_no, kpi_id)[1:5] AS first, greatest(0, count(*) - 5) AS more FROM i GROUP BY issue")(
    lambda t: issues(t).withColumn("s", F.struct("company", "run_no", "kpi_id")).groupBy("issue").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("s")), 1, 5).alias("l"))
    .select("issue", "n", F.transform("l", lambda x: F.concat_ws(":", x["company"].cast("string"), x["run_no"].cast("string"), x["kpi_id"])).alias("first"), F.greatest(F.lit(0), F.col("n") - 5).alias("more"))
)
VERBAL = "CASE WHEN confidence >= 0.6 THEN 'Answer well grounded in evidence' WHEN confidence >= 0.2 THEN 'Answer poorly grounded in evidence' ELSE 'Answer barely grounded in evidence' END"
query("metric_verbal", f"SELECT company, run_no, kpi_id, {VERBAL} AS verbal FROM kr")(
    lambda t: t("kr").select("company", "run_no", "kpi_id", S.verbal("ragas_faithfulness", F.col("confidence")).alias("verbal"))
)
query("citations_build", "SELECT company, run_no, kpi_id, list(concat(source_id, ' ', substr(url, 1, 240)) ORDER BY pos) AS citations FROM (SELECT *, row_number() OVER (PARTITION BY company, run_no, kpi_id ORDER BY pos) AS r FROM cites) WHERE r <= 3 GROUP BY 1, 2, 3")(
    lambda t: t("cites").withColumn("r", F.row_number().over(Window.partitionBy("company", "run_no", "kpi_id").orderBy("pos"))).where("r <= 3")
    .groupBy("company", "run_no", "kpi_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(" ", "source_id", F.substring("url", 1, 240)).alias("c")))), lambda x: x["c"]).alias("citations"))
)
query("evidence_block", "WITH c AS (SELECT qid, turn, string_agg('- [' || pos || '] ' || substr(context, 1, 1000), chr(10) ORDER BY pos) AS block FROM ctx GROUP BY 1, 2) SELECT qa.qid, qa.turn, coalesce(block, '(no evidence available)') AS block FROM qa LEFT JOIN c ON c.qid = qa.qid AND c.turn = qa.turn")(
    lambda t: t("qa").select("qid", "turn").join(
        t("ctx").groupBy("qid", "turn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "context"))), lambda x: F.concat(F.lit("- ["), x["pos"].cast("string"), F.lit("] "), F.substring(x["context"], 1, 1000))), "\n").alias("block")),
        ["qid", "turn"], "left",
    ).select("qid", "turn", F.coalesce("block", F.lit("(no evidence available)")).alias("block"))
)
query("kpi_evidence", "SELECT company, run_no, kpi_id, pos, CASE WHEN contains(url, 'investor') THEN 1 ELSE 2 END AS tier, substr(url, 1, 20) || '...' AS quote FROM cites")(
    lambda t: t("cites").select("company", "run_no", "kpi_id", "pos", F.when(F.col("url").contains("investor"), 1).otherwise(2).alias("tier"), F.concat(F.substring("url", 1, 20), F.lit("...")).alias("quote"))
)
query("citations_flatten", "SELECT company, kpi_id, source_id, substr(url, 1, 300) AS quote FROM cites")(lambda t: t("cites").select("company", "kpi_id", "source_id", F.substring("url", 1, 300).alias("quote")))
query("gt_comparison_rows", "SELECT o.company, o.kpi_id, o.score AS pipeline, w.score AS analyst, o.confidence AS match_confidence FROM kr o JOIN kr w ON o.company = w.company AND o.kpi_id = w.kpi_id AND o.run_no = 0 AND w.run_no = 3")(
    lambda t: t("kr").where("run_no = 0").select("company", "kpi_id", F.col("score").alias("pipeline"), F.col("confidence").alias("match_confidence"))
    .join(t("kr").where("run_no = 3").select("company", "kpi_id", F.col("score").alias("analyst")), ["company", "kpi_id"])
)
query("freshness_first_seen", "SELECT source_id, arg_min(kpi_id, pos) AS kpi_id, min(pos) AS pos FROM cites GROUP BY source_id")(lambda t: t("cites").groupBy("source_id").agg(F.min_by("kpi_id", "pos").alias("kpi_id"), F.min("pos").alias("pos")))
query("company_lookup", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042') UNION ALL SELECT c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042'))")(
    lambda t: t("customer").withColumn("hit", F.lower("c_name") == "customer#000000042").orderBy(F.desc("hit"), "c_custkey").limit(1).select("c_custkey", "c_name")
)
query("to_float", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS x FROM events")(
    lambda t: t("events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).try_cast("double").alias("x"))
)
query("json_extract", "SELECT event_id, regexp_extract('text ' || props || ' end', '(?s)\\{.*\\}', 0) AS body, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events")(
    lambda t: t("events").select("event_id", F.regexp_extract(F.concat(F.lit("text "), "props", F.lit(" end")), r"(?s)\{.*\}", 0).alias("body"), F.get_json_object("props", "$.k").cast("int").alias("k"))
)
query("fetch_log_parse", "SELECT page_id, split_part('[fetch] ' || url || ': ' || CASE WHEN page_id % 3 = 0 THEN 'ok' ELSE 'failed' END, ': ', 2) = 'ok' AS ok FROM pages")(
    lambda t: t("pages").select("page_id", (F.split_part(F.concat(F.lit("[fetch] "), "url", F.lit(": "), F.when(F.col("page_id") % 3 == 0, "ok").otherwise("failed")), F.lit(": "), F.lit(2)) == "ok").alias("ok"))
)
query("url_extract", "SELECT page_id, list_transform(regexp_extract_all(url || '). see ' || url || ';', 'https?://[^\\s]+'), lambda u: rtrim(u, '.,;)')) AS urls FROM pages")(
    lambda t: t("pages").select("page_id", F.transform(F.regexp_extract_all(F.concat("url", F.lit("). see "), "url", F.lit(";")), F.lit(r"https?://[^\s]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;)]+$", "")).alias("urls"))
)
query("claims_flatten", "SELECT company, kpi_id, unnest(list_value(source_id, url)) AS item FROM cites")(lambda t: t("cites").select("company", "kpi_id", F.explode(F.array("source_id", "url")).alias("item")))
for _i, (_n, _c) in enumerate((("split_table", "live_score"), ("gate_table", "confidence"), ("retrieval_table", "score"), ("attribution_table", "n"), ("trace_table", "first_event"))):
    query(_n, f"SELECT company, run_no, kpi_id, {_c} AS value FROM kr WHERE {_c} IS NOT NULL")(lambda t, c=_c: t("kr").where(F.col(c).isNotNull()).select("company", "run_no", "kpi_id", F.col(c).alias("value")))

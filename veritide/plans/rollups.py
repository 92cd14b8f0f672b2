"""Queries of roll-ups and distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritide.functions.numbers import even
from veritide.operators import scoring as S
from veritide.plans.base import query

GROUP = ("company", "run_no", "pillar")


def weighted(score, weight, digits=2):
    """Weighted mean on exact decimals, so that the order of summation cannot move a rounding edge."""
    d = lambda c: c.cast("decimal(20,6)")
    total = F.sum(d(weight))
    return even(F.when(total == 0, 0.0).otherwise(F.sum(d(score) * d(weight)).cast("double") / total.cast("double")), digits)


def pillars(t):
    k = t("kr")
    return k.groupBy(*GROUP).agg(
        weighted(F.coalesce("live_score", "score"), F.col("confidence")).alias("score"),
        even(F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.count("*"), 2).alias("confidence"),
        F.sort_array(F.collect_list("kpi_id")).alias("kpis"),
    )


def _wsql(score, weight, digits=2):
    return f"round_even(CASE WHEN sum(CAST({weight} AS DECIMAL(20,6))) = 0 THEN 0 ELSE sum(CAST({score} AS DECIMAL(16,6)) * CAST({weight} AS DECIMAL(16,6)))::DOUBLE / sum(CAST({weight} AS DECIMAL(20,6)))::DOUBLE END, {digits})"


PILLAR = f"""SELECT company, run_no, pillar, {_wsql('coalesce(live_score, score)', 'confidence')} AS score,
    round_even(sum(CAST(confidence AS DECIMAL(20,6)))::DOUBLE / count(*), 2) AS confidence, list_sort(list(kpi_id)) AS kpis FROM kr GROUP BY company, run_no, pillar"""

query("pillar_agg", PILLAR)(pillars)
query("overall_score", f"WITH p AS ({PILLAR}) SELECT company, run_no, {_wsql('score', 'confidence')} AS overall FROM p GROUP BY company, run_no")(
    lambda t: pillars(t).groupBy("company", "run_no").agg(weighted(F.col("score"), F.col("confidence")).alias("overall"))
)


@query(
    "parent_agg",
    f"""WITH x AS (SELECT p_brand, p_partkey, p_retailprice, p_size FROM part), l AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT p_brand AS parent, {_wsql('p_retailprice', 'coalesce(n, 0)', 2)} AS score, count(*) AS children, count(*) FILTER (WHERE n IS NULL) AS missing FROM x LEFT JOIN l ON p_partkey = l_partkey GROUP BY p_brand""",
)
def _(t):
    n = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = t("part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.groupBy(F.col("p_brand").alias("parent")).agg(
        weighted(F.col("p_retailprice"), F.coalesce("n", F.lit(0))).alias("score"), F.count("*").alias("children"), F.count_if(F.col("n").isNull()).alias("missing")
    )


BY = "company, run_no, kpi_id"
K = ("company", "run_no", "kpi_id")

query("tier_quality", f"SELECT {BY}, round_even(greatest(0, 0.15 - (avg(tier) - 1) * 0.15 / 2), 3) AS tier_quality FROM cites GROUP BY {BY}")(
    lambda t: t("cites").groupBy(*K).agg(S.tier_quality(F.avg("tier")).alias("tier_quality"))
)
query(
    "tier_distribution",
    f"SELECT {BY}, count(*) FILTER (WHERE tier = 1) AS tier1, count(*) FILTER (WHERE tier = 2) AS tier2, count(*) FILTER (WHERE tier = 3) AS tier3, round_even(avg(tier), 2) AS avg FROM cites GROUP BY {BY}",
)(lambda t: t("cites").groupBy(*K).agg(*(F.count_if(F.col("tier") == i).alias(f"tier{i}") for i in (1, 2, 3)), even(F.avg("tier"), 2).alias("avg")))
query("source_diversity", f"SELECT {BY}, count(DISTINCT nullif(source_id, '')) AS sources FROM cites GROUP BY {BY}")(
    lambda t: t("cites").groupBy(*K).agg(F.countDistinct(F.nullif("source_id", F.lit(""))).alias("sources"))
)


@query(
    "source_distribution",
    """WITH c AS (SELECT url, source_id, tier, regexp_extract(url, '://([^/]+)', 1) AS domain FROM cites),
       d AS (SELECT domain, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, domain) AS rank FROM c GROUP BY domain)
       SELECT domain, n, rank, round_even(n * 100.0::DOUBLE / (SELECT count(*) FROM c), 2) AS pct, (SELECT count(DISTINCT source_id) FROM c) AS sources FROM d WHERE rank <= 10""",
)
def _(t):
    c = t("cites").withColumn("domain", F.regexp_extract("url", "://([^/]+)", 1))
    total = c.agg(F.count("*").alias("total"), F.countDistinct("source_id").alias("sources"))
    top = c.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(10)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "domain")  # at most ten rows
    top = top.withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(total))
    return top.select("domain", "n", "rank", even(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"), "sources")


query(
    "score_distribution",
    "SELECT kpi_id, count(*) AS n, round_even(avg(score), 4) AS mean, round_even(coalesce(stddev_pop(score), 0), 4) AS sd FROM kr GROUP BY kpi_id",
)(lambda t: t("kr").groupBy("kpi_id").agg(F.count("*").alias("n"), even(F.avg("score"), 4).alias("mean"), even(F.coalesce(F.stddev_pop("score"), F.lit(0.0)), 4).alias("sd")))
query(
    "source_coverage",
    "SELECT source, count(*) AS n, CAST(sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS filled, CAST(sum(CASE WHEN text ILIKE 'the and%' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM documents GROUP BY source",
)(
    lambda t: t("documents").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.when(F.trim("text") != "", 1).otherwise(0)).alias("filled"), F.sum(F.when(F.col("text").ilike("the and%"), 1).otherwise(0)).alias("errors")
    )
)
query("signal_status", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")(lambda t: t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")))
query("source_eval_avg", "SELECT count(*) AS n, round_even(avg(coalesce(live_score, 0)), 4) AS mean FROM kr")(
    lambda t: t("kr").agg(F.count("*").alias("n"), even(F.avg(F.coalesce("live_score", F.lit(0.0))), 4).alias("mean"))
)


@query(
    "rag_metric_avgs",
    "WITH a AS (SELECT avg(score) AS score, avg(confidence) AS confidence, avg(live_score) AS live_score FROM kr) SELECT metric, round(value, 6) AS value FROM (UNPIVOT a ON score, confidence, live_score INTO NAME metric VALUE value)",
)
def _(t):
    k = t("kr")
    names = [f.name for f in k.schema if f.dataType.typeName() in ("double", "decimal") and ("score" in f.name or "confidence" in f.name)]
    return k.agg(*(F.round(F.avg(c), 6).cast("double").alias(c) for c in names)).unpivot([], names, "metric", "value")


@query(
    "mean_std_cols",
    """WITH s AS (SELECT 'score' AS metric, score::DOUBLE AS v FROM kr UNION ALL SELECT 'confidence', confidence FROM kr UNION ALL SELECT 'live_score', live_score FROM kr)
       SELECT metric, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS sd FROM s GROUP BY metric""",
)
def _(t):
    k = t("kr").select(*(F.col(c).cast("double").alias(c) for c in ("score", "confidence", "live_score")))
    long = k.unpivot([], ["score", "confidence", "live_score"], "metric", "v")
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_pop("v"), 5).alias("sd"))


QUALITY = "list_avg(list_filter([score / 5, confidence, live_score / 5, CASE WHEN n > 2 THEN 1 - least(1, greatest(0, n / 20.0)) END], lambda x: x IS NOT NULL))"


@query(
    "rag_pillar_quality",
    f"""WITH k AS (SELECT pillar, {QUALITY} AS q FROM kr), p AS (SELECT pillar, round(avg(q), 5) AS quality FROM k GROUP BY pillar)
        SELECT pillar, quality, CASE WHEN quality >= 0.7 THEN 'good' WHEN quality >= 0.4 THEN 'fair' ELSE 'poor' END AS band FROM p""",
)
def _(t):
    d = lambda c: F.col(c).cast("double")
    inverted = F.when(F.col("n") > 2, 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n") / 20.0)))
    xs = F.array_compact(F.array(d("score") / 5, d("confidence"), d("live_score") / 5, inverted))
    q = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    p = t("kr").select("pillar", q.alias("q")).groupBy("pillar").agg(F.round(F.avg("q"), 5).alias("quality"))
    return p.withColumn("band", F.when(F.col("quality") >= 0.7, "good").when(F.col("quality") >= 0.4, "fair").otherwise("poor"))


LATEST = "last AS (SELECT company, max(run_no) AS run_no FROM kr GROUP BY company)"


@query("company_rag_summary", f"WITH {LATEST} SELECT k.company, k.run_no, round(avg(score), 5) AS score, round(avg(confidence), 5) AS confidence, round(coalesce(avg(live_score), 0), 5) AS live FROM kr k JOIN last ON k.company = last.company AND k.run_no = last.run_no GROUP BY 1, 2")
def _(t):
    k = t("kr")
    last = k.groupBy("company").agg(F.max("run_no").alias("run_no"))
    return k.join(last, ["company", "run_no"]).groupBy("company", "run_no").agg(
        F.round(F.avg("score"), 5).alias("score"), F.round(F.avg("confidence"), 5).alias("confidence"), F.round(F.coalesce(F.avg("live_score"), F.lit(0.0)), 5).alias("live")
    )


query("latest_per_company", f"WITH {LATEST} SELECT company, run_no FROM last")(lambda t: t("kr").groupBy("company").agg(F.max("run_no").alias("run_no")))


@query(
    "rag_batch_summary",
    """WITH s AS (SELECT company, run_no, count(*) AS n, count(*) FILTER (WHERE confidence < 0.3) AS flagged, list_sort(list(kpi_id) FILTER (WHERE confidence < 0.3)) AS ids, round(avg(score), 5) AS mean FROM kr GROUP BY 1, 2)
       SELECT company, run_no, n, flagged, coalesce(ids, []) AS ids, mean, CASE WHEN flagged = 0 THEN 'clean' WHEN flagged::DOUBLE / n <= 0.2 THEN 'minor' ELSE 'major' END AS verdict FROM s""",
)
def _(t):
    low = F.col("confidence") < 0.3
    s = t("kr").groupBy("company", "run_no").agg(F.count("*").alias("n"), F.count_if(low).alias("flagged"), F.sort_array(F.collect_list(F.when(low, F.col("kpi_id")))).alias("ids"), F.round(F.avg("score"), 5).alias("mean"))
    return s.withColumn("verdict", F.when(F.col("flagged") == 0, "clean").when(F.col("flagged") / F.col("n") <= 0.2, "minor").otherwise("major"))


OPTIONAL = ("live_score", "score", "confidence", "pillar", "n", "first_event")
query("feature_coverage", f"SELECT {', '.join(f'count({c}) AS {c}' for c in OPTIONAL)}, count(*) AS kpis FROM kr")(
    lambda t: t("kr").agg(*(F.count(c).alias(c) for c in OPTIONAL), F.count("*").alias("kpis"))
)
query("cited_sources", "SELECT source_id, count(DISTINCT kpi_id) AS n, list_sort(list(DISTINCT kpi_id)) AS kpis FROM cites GROUP BY source_id")(
    lambda t: t("cites").groupBy("source_id").agg(F.countDistinct("kpi_id").alias("n"), F.sort_array(F.collect_set("kpi_id")).alias("kpis"))
)
query(
    "cot_dimension_avg",
    "SELECT pillar, round(avg(tier), 5) AS mean, bool_or(tier < 2) AS weak FROM cites GROUP BY pillar",
)(lambda t: t("cites").groupBy("pillar").agg(F.round(F.avg("tier"), 5).alias("mean"), F.bool_or(F.col("tier") < 2).alias("weak")))
query(
    "bertscore_summary",
    "SELECT round(avg(confidence), 5) AS mean, count(*) FILTER (WHERE confidence < 0.75) AS low, round(count(*) FILTER (WHERE confidence >= 0.75)::DOUBLE / count(*), 5) AS pass_rate FROM kr",
)(lambda t: t("kr").agg(F.round(F.avg("confidence"), 5).alias("mean"), F.count_if(F.col("confidence") < 0.75).alias("low"), F.round(F.count_if(F.col("confidence") >= 0.75) / F.count("*"), 5).alias("pass_rate")))

RANGES = ((0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.0))


@query(
    "confidence_histogram",
    " UNION ALL ".join(f"SELECT {i} AS bin, count(*) AS n FROM kr WHERE confidence >= {lo} AND confidence {'<=' if hi == 1.0 else '<'} {hi}" for i, (lo, hi) in enumerate(RANGES)),
)
def _(t):
    inside = lambda lo, hi: (F.col("confidence") >= lo) & ((F.col("confidence") <= hi) if hi == 1.0 else (F.col("confidence") < hi))
    one = t("kr").agg(*(F.count_if(inside(lo, hi)).alias(str(i)) for i, (lo, hi) in enumerate(RANGES)))
    return one.unpivot([], [str(i) for i in range(5)], "bin", "n").select(F.col("bin").cast("int").alias("bin"), "n")


query("adoption_avgs", "SELECT pillar, round(avg(CASE WHEN tier = 1 THEN 1 ELSE 0 END), 5) AS t1, round(avg(CASE WHEN tier = 2 THEN 1 ELSE 0 END), 5) AS t2, round(avg(value) FILTER (WHERE tier = 1), 5) AS v1 FROM cites GROUP BY pillar")(
    lambda t: t("cites").groupBy("pillar").agg(F.round(F.avg(F.when(F.col("tier") == 1, 1).otherwise(0)), 5).alias("t1"), F.round(F.avg(F.when(F.col("tier") == 2, 1).otherwise(0)), 5).alias("t2"), F.round(F.avg(F.when(F.col("tier") == 1, F.col("value"))), 5).alias("v1"))
)
query("url_top20", "SELECT url, count(*) AS n FROM cites GROUP BY url ORDER BY n DESC, url LIMIT 20")(lambda t: t("cites").groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(20))
query("coverage_ratio", "SELECT company, count(DISTINCT pillar) FILTER (WHERE pillar IN ('view', 'click', 'signup', 'purchase', 'home'))::DOUBLE / 5 AS ratio FROM kr GROUP BY company")(
    lambda t: t("kr").groupBy("company").agg((F.countDistinct(F.when(F.col("pillar").isin("view", "click", "signup", "purchase", "home"), F.col("pillar"))) / 5.0).alias("ratio"))
)
query("empty_retrieval_rate", "SELECT company, round(count(*) FILTER (WHERE n < 3)::DOUBLE / greatest(count(*), 1), 6) AS rate FROM kr GROUP BY company")(
    lambda t: t("kr").groupBy("company").agg(F.round(F.count_if(F.col("n") < 3) / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))
)
query("groundedness_ratio", "SELECT run_no, round(avg(CASE WHEN m > 1 THEN 1 ELSE 0 END), 6) AS ratio FROM (SELECT company, run_no, kpi_id, min(value) AS m FROM cites GROUP BY 1, 2, 3) GROUP BY run_no")(
    lambda t: t("cites").groupBy(*K).agg(F.min("value").alias("m")).groupBy("run_no").agg(F.round(F.avg(F.when(F.col("m") > 1, 1).otherwise(0)), 6).alias("ratio"))
)
query("score_stability", "SELECT company, round(avg(s), 5) AS stability FROM (SELECT company, kpi_id, stddev_pop(score) AS s FROM kr GROUP BY 1, 2) GROUP BY company")(
    lambda t: t("kr").groupBy("company", "kpi_id").agg(F.stddev_pop("score").alias("s")).groupBy("company").agg(F.round(F.avg("s"), 5).alias("stability"))
)
query("scoring_stats", "SELECT company, kpi_id, round_even(avg(score), 4) AS mean, round_even(coalesce(stddev_samp(score), 0), 4) AS sd, count(*) AS n FROM kr GROUP BY 1, 2")(
    lambda t: t("kr").groupBy("company", "kpi_id").agg(even(F.avg("score"), 4).cast("double").alias("mean"), even(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 4).alias("sd"), F.count("*").alias("n"))
)


@query(
    "snapshot_fingerprint",
    """WITH x AS (SELECT DISTINCT company, source_id, max(strftime(ts, '%Y-%m-%d')) AS d FROM cites GROUP BY company, source_id)
       SELECT company, sha256('[' || string_agg('["' || source_id || '","' || d || '"]', ',' ORDER BY source_id) || ']') AS fingerprint FROM x GROUP BY company""",
)
def _(t):
    x = t("cites").groupBy("company", "source_id").agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("d"))
    one = F.concat(F.lit('["'), "source_id", F.lit('","'), "d", F.lit('"]'))
    return x.groupBy("company").agg(F.sha2(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(one)), ","), F.lit("]")), 256).alias("fingerprint"))


@query(
    "db_kpi_import",
    r"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, p_size, p_retailprice FROM part),
        n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS i FROM s)
        SELECT p_partkey, CASE WHEN i > 1 THEN s || '_' || p_partkey ELSE s END AS kpi_id, least(5, greatest(1, p_size)) AS score, CASE WHEN p_size % 5 = 0 THEN 0.7 ELSE least(1, greatest(0, p_size / 40.0)) END AS confidence FROM n""",
)
def _(t):
    from veritide.functions.text import slug

    p = t("part").withColumn("s", slug(F.col("p_type")))
    w = Window.partitionBy("s").orderBy("p_partkey")
    given = F.col("p_size") % 5 != 0
    return p.withColumn("i", F.row_number().over(w)).select(
        "p_partkey", F.when(F.col("i") > 1, F.concat("s", F.lit("_"), F.col("p_partkey").cast("string"))).otherwise(F.col("s")).alias("kpi_id"),
        F.least(F.lit(5), F.greatest(F.lit(1), "p_size")).alias("score"), F.when(given, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p_size") / 40.0))).otherwise(0.7).alias("confidence"),
    )


query("eval_summary", "SELECT company, count(*) FILTER (WHERE live_score IS NOT NULL) AS matched, count(*) FILTER (WHERE live_score IS NULL) AS unmatched FROM kr GROUP BY company")(
    lambda t: t("kr").groupBy("company").agg(F.count("live_score").alias("matched"), F.count_if(F.col("live_score").isNull()).alias("unmatched"))
)
query("kpis_by_pillar", "SELECT coalesce(CASE WHEN pillar <> 'error' THEN pillar END, 'Other') AS pillar, list_sort(list(DISTINCT kpi_id)) AS kpis FROM kr GROUP BY 1")(
    lambda t: t("kr").groupBy(F.coalesce(F.when(F.col("pillar") != "error", F.col("pillar")), F.lit("Other")).alias("pillar")).agg(F.sort_array(F.collect_set("kpi_id")).alias("kpis"))
)
query("recent_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")(lambda t: t("orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50))
query("first_n_unique", "SELECT kpi_id, first_seen FROM (SELECT kpi_id, min(pos) AS first_seen FROM cites GROUP BY kpi_id) ORDER BY first_seen LIMIT 7")(
    lambda t: t("cites").groupBy("kpi_id").agg(F.min("pos").alias("first_seen")).orderBy("first_seen").limit(7)
)

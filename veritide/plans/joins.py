"""Queries of projections, joins, diffs and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritide.functions.numbers import even
from veritide.plans.base import query

KEY = ("company", "kpi_id")


def run(t, n, **names):
    return t("kr").where(F.col("run_no") == n).select(*KEY, *(F.col(c).alias(a) for a, c in names.items()))


DIFF = """o AS (SELECT company, kpi_id, score, confidence FROM kr WHERE run_no = 1), w AS (SELECT company, kpi_id, score, confidence FROM kr WHERE run_no = 2),
    d AS (SELECT coalesce(o.company, w.company) AS company, coalesce(o.kpi_id, w.kpi_id) AS kpi_id, o.score AS old, w.score AS new, o.confidence AS old_conf, w.confidence AS new_conf
          FROM o FULL JOIN w ON o.company = w.company AND o.kpi_id = w.kpi_id)"""


def diff(t):
    return run(t, 1, old="score", old_conf="confidence").join(run(t, 2, new="score", new_conf="confidence"), list(KEY), "full")


@query(
    "snapshot_diff",
    f"""WITH {DIFF}, u AS (SELECT company, kpi_id, list(DISTINCT url) FILTER (WHERE run_no = 1) AS a, list(DISTINCT url) FILTER (WHERE run_no = 2) AS b FROM cites WHERE run_no IN (1, 2) GROUP BY 1, 2)
        SELECT d.company, d.kpi_id, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new OR old_conf <> new_conf THEN 'changed' ELSE 'same' END AS status,
               round_even(coalesce(new, 0) - coalesce(old, 0), 4) AS score_delta, list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS added, list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS removed
        FROM d LEFT JOIN u ON u.company = d.company AND u.kpi_id = d.kpi_id""",
)
def _(t):
    at = lambda n: F.collect_set(F.when(F.col("run_no") == n, F.col("url")))
    u = t("cites").where("run_no IN (1, 2)").groupBy(*KEY).agg(at(1).alias("a"), at(2).alias("b"))
    changed = (F.col("old") != F.col("new")) | (F.col("old_conf") != F.col("new_conf"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(changed, "changed").otherwise("same")
    zero = F.lit(0.0)
    return diff(t).join(u, list(KEY), "left").select(
        *KEY, status.alias("status"), even(F.coalesce("new", zero) - F.coalesce("old", zero), 4).alias("score_delta"),
        F.sort_array(F.array_except("b", "a")).alias("added"), F.sort_array(F.array_except("a", "b")).alias("removed"),
    )


@query(
    "run_diff",
    f"WITH {DIFF} SELECT company, kpi_id, old, new, round_even(new - old, 4) AS delta FROM d",
)
def _(t):
    return diff(t).select(*KEY, "old", "new", even(F.col("new") - F.col("old"), 4).alias("delta"))


@query(
    "run_diff_summary",
    f"""WITH {DIFF} SELECT company, count(*) FILTER (WHERE old <> new) AS changed_score, count(*) FILTER (WHERE abs(old_conf - new_conf) >= 0.01) AS changed_conf,
        count(*) FILTER (WHERE old IS NULL) AS only_new, count(*) FILTER (WHERE new IS NULL) AS only_old FROM d GROUP BY company""",
)
def _(t):
    return diff(t).groupBy("company").agg(
        F.count_if(F.col("old") != F.col("new")).alias("changed_score"), F.count_if(F.abs(F.col("old_conf") - F.col("new_conf")) >= 0.01).alias("changed_conf"),
        F.count_if(F.col("old").isNull()).alias("only_new"), F.count_if(F.col("new").isNull()).alias("only_old"),
    )


query("report_compare", f"WITH {DIFF} SELECT company, kpi_id, round_even(new - old, 4) AS score_delta, round_even(new_conf - old_conf, 4) AS conf_delta FROM d WHERE old IS NOT NULL AND new IS NOT NULL")(
    lambda t: run(t, 1, old="score", old_conf="confidence").join(run(t, 2, new="score", new_conf="confidence"), list(KEY)).select(*KEY, even(F.col("new") - F.col("old"), 4).alias("score_delta"), even(F.col("new_conf") - F.col("old_conf"), 4).alias("conf_delta"))
)
query("top_changes", f"WITH {DIFF} SELECT company, kpi_id, round_even(new - old, 4) AS delta FROM d WHERE new <> old ORDER BY abs(round_even(new - old, 4)) DESC, company, kpi_id LIMIT 15")(
    lambda t: diff(t).where("new <> old").select(*KEY, even(F.col("new") - F.col("old"), 4).alias("delta")).orderBy(F.desc(F.abs("delta")), *KEY).limit(15)
)
query("confidence_gains", f"WITH {DIFF} SELECT company, kpi_id, round_even(new_conf - old_conf, 4) AS gain FROM d WHERE new_conf > old_conf ORDER BY gain DESC, company, kpi_id LIMIT 10")(
    lambda t: diff(t).where("new_conf > old_conf").select(*KEY, even(F.col("new_conf") - F.col("old_conf"), 4).alias("gain")).orderBy(F.desc("gain"), *KEY).limit(10)
)


@query("unmatched", "SELECT doc_id AS id, 'document' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT page_id, 'page' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    d, p, l = t("documents").select(F.col("doc_id").alias("id")), t("pages").select(F.col("page_id").alias("id")), t("labels").select(F.col("doc_id").alias("id"))
    return d.join(l, "id", "left_anti").withColumn("side", F.lit("document")).unionByName(p.join(l, "id", "left_anti").withColumn("side", F.lit("page")))


@query(
    "chunk_source_join",
    "SELECT l_orderkey, l_linenumber, s.s_name AS source, coalesce(s.s_suppkey, -1) AS source_id FROM lineitem LEFT JOIN supplier s ON l_suppkey = s_suppkey",
)
def _(t):
    s = t("supplier").dropDuplicates(["s_suppkey"])
    return t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", F.col("s_name").alias("source"), F.coalesce("s_suppkey", F.lit(-1)).alias("source_id"))


query("kpi_rag_join", "SELECT d.doc_id, d.lang, l.quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(
    lambda t: t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))
)
query("merge_eval", "WITH o AS (SELECT * FROM kr WHERE run_no = 1), w AS (SELECT * FROM kr WHERE run_no = 2) SELECT o.company, o.kpi_id, coalesce(w.live_score, o.live_score) AS live_score, coalesce(w.score, o.score) AS score FROM o LEFT JOIN w ON o.company = w.company AND o.kpi_id = w.kpi_id")(
    lambda t: run(t, 1, a="live_score", b="score").join(run(t, 2, c="live_score", d="score"), list(KEY), "left").select(*KEY, F.coalesce("c", "a").alias("live_score"), F.coalesce("d", "b").alias("score"))
)
query("kar_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")(
    lambda t: t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")
)
query("report_companies", "SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")(
    lambda t: t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name").distinct()
)
query("source_eval_join", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")(
    lambda t: t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")
)


@query("run_subquery", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 3 AND c_custkey IN (SELECT o_custkey FROM orders))")
def _(t):
    buyers = t("customer").where("c_nationkey = 3").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    one = buyers.agg(F.max("c_custkey").alias("k"))  # one row
    return t("orders").join(F.broadcast(one), F.col("o_custkey") == F.col("k")).select("o_orderkey", "o_custkey")


@query(
    "golden_merge",
    "WITH y AS (SELECT vec_id AS id, 1.0 + label AS rel FROM embeddings WHERE vec_id % 2 = 0), d AS (SELECT vec_id AS id, 2.0 * label AS rel FROM embeddings WHERE vec_id % 3 = 0) SELECT coalesce(y.id, d.id) AS id, CAST(coalesce(d.rel, y.rel) AS DOUBLE) AS relevance FROM y FULL JOIN d ON y.id = d.id",
)
def _(t):
    e = t("embeddings")
    y = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (1.0 + F.col("label")).alias("y"))
    d = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (2.0 * F.col("label")).alias("d"))
    return y.join(d, "id", "full").select("id", F.coalesce("d", "y").alias("relevance"))


query("golden_lookup", "WITH g AS (SELECT label, vec_id % 50 AS chunk, vec_id, row_number() OVER (PARTITION BY label, vec_id % 50 ORDER BY vec_id DESC) AS i FROM embeddings) SELECT label, chunk, CAST(vec_id AS DOUBLE) AS relevance FROM g WHERE i = 1")(
    lambda t: t("embeddings").groupBy("label", (F.col("vec_id") % 50).alias("chunk")).agg(F.max_by(F.col("vec_id").cast("double"), "vec_id").alias("relevance"))
)
query("parent_child_join", "SELECT r_name AS parent, list_sort(list(n_name)) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")(
    lambda t: t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("parent")).agg(F.sort_array(F.collect_list("n_name")).alias("children"))
)
query("previous_state_join", "SELECT company, kpi_id, run_no, lag(score) OVER (PARTITION BY company, kpi_id ORDER BY run_no) AS previous FROM kr")(lambda t: t("kr").select(*KEY, "run_no", F.lag("score").over(Window.partitionBy(*KEY).orderBy("run_no")).alias("previous")))
query("previous_snapshot", "SELECT company, run_no, lag(run_no) OVER (PARTITION BY company ORDER BY run_no) AS previous FROM (SELECT DISTINCT company, run_no FROM kr)")(
    lambda t: t("kr").select("company", "run_no").distinct().withColumn("previous", F.lag("run_no").over(Window.partitionBy("company").orderBy("run_no")))
)


@query(
    "score_attribution",
    """WITH s AS (SELECT company, kpi_id, run_no, score, n % 3 AS model, n % 4 AS prompt, first_event % 2 AS data FROM kr),
       p AS (SELECT *, lag(score) OVER w AS ps, lag(model) OVER w AS pm, lag(prompt) OVER w AS pp, lag(data) OVER w AS pd FROM s WINDOW w AS (PARTITION BY company, kpi_id ORDER BY run_no))
       SELECT company, kpi_id, run_no, round_even(score - ps, 4) AS delta, CASE WHEN ps IS NULL OR abs(round_even(score - ps, 4)) <= 0.2 THEN NULL WHEN model <> pm THEN 'model_change' WHEN prompt <> pp THEN 'prompt_change' WHEN data <> pd THEN 'data_change' ELSE 'external_noise' END AS cause FROM p""",
)
def _(t):
    from veritide.operators.attribution import attribute

    s = t("kr").select(*KEY, "run_no", "score", (F.col("n") % 3).alias("model"), (F.col("n") % 4).alias("prompt"), (F.col("first_event") % 2).alias("data"))
    return attribute(s, KEY, "run_no", "score", (("model", "model_change"), ("prompt", "prompt_change"), ("data", "data_change")))


query("url_overlap_jaccard", "WITH u AS (SELECT company, kpi_id, list(DISTINCT url) FILTER (WHERE run_no = 1) AS a, list(DISTINCT url) FILTER (WHERE run_no = 2) AS b FROM cites GROUP BY 1, 2) SELECT company, kpi_id, round_even(len(list_intersect(coalesce(a, []), coalesce(b, [])))::DOUBLE / greatest(1, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))), 3) AS jaccard FROM u")(
    lambda t: t("cites").groupBy(*KEY).agg(*(F.collect_set(F.when(F.col("run_no") == n, F.col("url"))).alias(c) for n, c in ((1, "a"), (2, "b"))))
    .select(*KEY, even(F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size(F.array_union("a", "b"))), 3).alias("jaccard"))
)


@query("gt_fuzzy_match")
def _(t):
    from veritide.operators.fuzzy import best_matches

    names = t("part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name")).distinct()
    return best_matches(names, t("part").select(F.col("p_type").alias("truth")).distinct())


# projections and filters
query("url_parse", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS netloc, coalesce(nullif(regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1), ''), 'home') AS page_type FROM pages")(
    lambda t: t("pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("netloc"), F.coalesce(F.nullif(F.regexp_extract("url", "://[^/?#]*/([^/?#]*)", 1), F.lit("")), F.lit("home")).alias("page_type"))
)
HOSTS = "SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^[w.]+', '') AS domain FROM pages"
host = lambda t: t("pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), "^[w.]+", "").alias("domain"))
query("domain_strip", HOSTS)(host)
query("dominant_domain", f"WITH h AS ({HOSTS}) SELECT domain, count(*) AS n FROM h GROUP BY domain ORDER BY n DESC, min(page_id) LIMIT 1")(
    lambda t: host(t).groupBy("domain").agg(F.count("*").alias("n"), F.min("page_id").alias("p")).orderBy(F.desc("n"), "p").limit(1).select("domain", "n")
)
query("kpi_filter", "SELECT kpi_id, first FROM (SELECT kpi_id, min(pos) AS first FROM cites WHERE kpi_id IN ('view_1', 'view_2', 'click_3', 'error_0') GROUP BY kpi_id) ORDER BY first LIMIT 3")(
    lambda t: t("cites").where(F.col("kpi_id").isin("view_1", "view_2", "click_3", "error_0")).groupBy("kpi_id").agg(F.min("pos").alias("first")).orderBy("first").limit(3)
)
query("min_match_filter", "SELECT company, run_no, kpi_id, confidence FROM kr WHERE confidence >= 0.5 AND floor(score) IN (2, 3)")(lambda t: t("kr").where((F.col("confidence") >= 0.5) & F.floor("score").isin(2, 3)).select("company", "run_no", "kpi_id", "confidence"))
query("pillar_filter", "SELECT company, run_no, kpi_id FROM kr WHERE pillar IN ('view', 'click')")(lambda t: t("kr").where(F.col("pillar").isin("view", "click")).select("company", "run_no", "kpi_id"))
query("data_quality_flag", "SELECT doc_id, CASE WHEN text ILIKE 'the and attion%' THEN 'fetch_error' WHEN coalesce(nullif(trim(text), ''), '') = '' THEN 'empty_content' ELSE 'ok' END AS flag FROM documents ORDER BY flag DESC, doc_id LIMIT 200")(
    lambda t: t("documents").select("doc_id", F.when(F.col("text").ilike("the and attion%"), "fetch_error").when(F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("")) == "", "empty_content").otherwise("ok").alias("flag")).orderBy(F.desc("flag"), "doc_id").limit(200)
)
query("source_record_dedup", "SELECT min(page_id) AS page_id, url FROM pages WHERE url <> '' GROUP BY url ORDER BY page_id LIMIT 70")(lambda t: t("pages").where("url <> ''").groupBy("url").agg(F.min("page_id").alias("page_id")).orderBy("page_id").limit(70))
query("discover_urls", "WITH n AS (SELECT page_id, rtrim(regexp_replace(url, '#.*$', ''), '/') AS url FROM pages WHERE regexp_matches(url, '://[^/?#]*example\\.com')) SELECT url, min(page_id) AS page_id FROM n GROUP BY url ORDER BY page_id LIMIT 50")(
    lambda t: t("pages").where(F.col("url").rlike(r"://[^/?#]*example\.com")).select("page_id", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", "").alias("url")).groupBy("url").agg(F.min("page_id").alias("page_id")).orderBy("page_id").limit(50)
)
query("fetch_html", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")(
    lambda t: t("pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "), r"\s+", " ")).alias("text"))
)
query("tier_keyword", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'product|pricing|revenue|pipeline') THEN 1 WHEN length(text) > 80 THEN 2 ELSE 3 END AS tier FROM documents")(
    lambda t: t("documents").select("doc_id", F.when(F.lower("text").rlike("product|pricing|revenue|pipeline"), 1).when(F.char_length("text") > 80, 2).otherwise(3).alias("tier"))
)
query("inferred_tier", "SELECT pos, CASE WHEN contains(url, 'investor') OR contains(url, 'annual-report') OR contains(url, '.pdf') THEN 1 ELSE 2 END AS tier FROM cites")(
    lambda t: t("cites").select("pos", F.when(F.col("url").contains("investor") | F.col("url").contains("annual-report") | F.col("url").contains(".pdf"), 1).otherwise(2).alias("tier"))
)
query("score_band", "SELECT company, run_no, kpi_id, CASE WHEN score / 5 >= 0.75 THEN 'high' WHEN score / 5 >= 0.5 THEN 'mid' ELSE 'low' END AS band, CASE WHEN confidence >= 0.7 THEN 'Fresh' WHEN confidence >= 0.4 THEN 'Moderate' ELSE 'Stale' END AS fresh FROM kr")(
    lambda t: t("kr").select("company", "run_no", "kpi_id", F.when(F.col("score") / 5 >= 0.75, "high").when(F.col("score") / 5 >= 0.5, "mid").otherwise("low").alias("band"), F.when(F.col("confidence") >= 0.7, "Fresh").when(F.col("confidence") >= 0.4, "Moderate").otherwise("Stale").alias("fresh"))
)

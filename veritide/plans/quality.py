"""Queries of source-quality text mining over whole tables, by the default word and pattern lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritide.functions.numbers import even
from veritide.operators import source_quality as Q
from veritide.plans.base import query
from veritide.plans.evidence import CLAIM_SQL, LEAF, TIER_SQL

@query(
    "tier_classify",
    f"WITH src AS (SELECT doc_id AS source_id, text, concat('https://', source, '.example.com/', {LEAF}) AS url FROM documents), {TIER_SQL} SELECT source_id AS doc_id, tier, content_score, signals, words, boilerplate_hits FROM tier",
)
def _(t):
    leaf = F.when(F.col("doc_id") % 7 == 0, "report").when(F.col("doc_id") % 5 == 0, "blog").otherwise("x")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), leaf)
    return t("documents").select("doc_id", Q.tier_classify(url, F.col("text")).alias("c")).select("doc_id", "c.*")


@query(
    "extract_claims",
    f"WITH src AS (SELECT doc_id AS source_id, text FROM documents), ev AS (SELECT 0 AS grp, source_id FROM src), {CLAIM_SQL} SELECT source_id, pos, claim FROM g",
)
def _(t):
    return Q.extract_claims(t("documents"), "doc_id", "text")


DATED = "d AS (SELECT o_orderkey, concat('seen ', strftime(o_orderdate, '%-d %B %Y'), ' and ', strftime(o_orderdate, '%Y-%m-%d'), ', 2025-02-30') AS text, o_orderdate FROM orders)"
_MON = "list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower(regexp_extract(text, '([A-Za-z]{3,9}) (?:20|19)', 1)))"


def dated(t):
    text = F.concat(F.lit("seen "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" and "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", 2025-02-30"))
    return t("orders").select("o_orderkey", text.alias("text"), "o_orderdate")


def _dates_sql(day: int, own: bool) -> str:
    mid = f"make_date(year(o_orderdate), month(o_orderdate), {day})"
    own_date = "CAST(o_orderdate AS DATE), " if own else ""
    return f"SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN list_sort([CAST(o_orderdate AS DATE), {own_date}{mid}]) ELSE [] END AS dates FROM orders"


query("extract_dates", _dates_sql(15, True))(lambda t: dated(t).select("o_orderkey", F.array_sort(Q.extract_dates(F.col("text"))).alias("dates")))
query("parse_dates_v1", _dates_sql(1, False))(lambda t: dated(t).select("o_orderkey", F.array_sort(Q.extract_dates(F.col("text"), 1, False)).alias("dates")))
FRESH = "greatest(0.1::DOUBLE, round_even(1 - pow(least(1.0::DOUBLE, greatest(0, floor(date_diff('second', o_orderdate, TIMESTAMP '1998-12-01') / 86400.0)) / 730.0), 0.7::DOUBLE), 3))"


def fresh(t):
    return t("orders").withColumn("f", Q.freshness(F.col("o_orderdate").cast("timestamp"), F.lit("1998-12-01").cast("timestamp")))


query("freshness", f"SELECT o_orderkey, {FRESH} AS freshness FROM orders")(lambda t: fresh(t).select("o_orderkey", F.col("f").alias("freshness")))
query(
    "freshness_boost",
    f"WITH g AS (SELECT o_custkey, round(avg({FRESH}), 9) AS a FROM orders GROUP BY 1) SELECT o_custkey, round_even(CASE WHEN a >= 0.7 THEN 0.10::DOUBLE * (a - 0.7) / 0.3 WHEN a < 0.4 THEN -0.15::DOUBLE * (0.4 - a) / 0.4 ELSE 0::DOUBLE END, 3) AS boost FROM g",
)(lambda t: fresh(t).groupBy("o_custkey").agg(F.round(F.avg("f"), 9).alias("a")).select("o_custkey", Q.freshness_boost(F.col("a")).alias("boost")))

HOSTED = "concat('https://', CASE doc_id % 6 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'news.reuters.com' WHEN 2 THEN 'gartner.com' WHEN 3 THEN 'eur.europa.eu' ELSE source || '.net' END, '/x')"
CONTENT = ["(?i)" + "|".join(p) for _, _, p in Q.AUTHORITY_CONTENT]
AUTH = f"""h AS (SELECT doc_id, text, replace(lower(regexp_extract({HOSTED}, '^[^:]*://([^/?#]*)', 1)), 'www.', '') AS host FROM documents),
    a AS (SELECT doc_id, host, CASE WHEN host = 'example.com' THEN 'first_party' WHEN host LIKE '%gartner.com' OR host LIKE '%forrester.com' THEN 'third_party_analyst' WHEN host LIKE '%reuters.com' THEN 'third_party_news' WHEN host LIKE '%europa.eu' THEN 'regulatory'
      WHEN regexp_matches(lower(text), '{CONTENT[0]}') THEN 'third_party_analyst ' WHEN regexp_matches(lower(text), '{CONTENT[1]}') THEN 'third_party_news ' WHEN regexp_matches(lower(text), '{CONTENT[2]}') THEN 'regulatory ' ELSE 'unknown' END AS k FROM h)"""


def authorities(t):
    m = F.col("doc_id") % 6
    name = F.when(m == 0, "www.example.com").when(m == 1, "news.reuters.com").when(m == 2, "gartner.com").when(m == 3, "eur.europa.eu").otherwise(F.concat("source", F.lit(".net")))
    return t("documents").select("doc_id", Q.authority(F.concat(F.lit("https://"), name, F.lit("/x")), F.col("text"), "example.com").alias("c")).select("doc_id", "c.*")


query(
    "authority_classify",
    f"WITH {AUTH} SELECT doc_id, trim(k) AS kind, CASE k WHEN 'first_party' THEN 0.5 WHEN 'third_party_analyst' THEN 0.9 WHEN 'third_party_news' THEN 0.8 WHEN 'regulatory' THEN 0.95 WHEN 'third_party_analyst ' THEN 0.7 WHEN 'third_party_news ' THEN 0.65 WHEN 'regulatory ' THEN 0.75 ELSE 0.4 END::DOUBLE AS score, k <> 'first_party' AS third FROM a",
)(authorities)
query(
    "authority_distribution",
    f"WITH {AUTH} SELECT trim(k) AS kind, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM a), 3) AS pct FROM a GROUP BY 1",
)(
    lambda t: authorities(t).groupBy("kind").agg(F.count("*").alias("n")).crossJoin(F.broadcast(t("documents").agg(F.count("*").alias("all"))))
    .select("kind", "n", even(F.col("n") * 100.0 / F.col("all"), 3).alias("pct"))
)
query(
    "authority_boost",
    f"WITH {AUTH}, g AS (SELECT doc_id // 7 AS grp, bool_or(k = 'first_party') AS f, bool_or(k LIKE 'third%' OR k LIKE 'reg%') AS th FROM a GROUP BY 1) SELECT grp, CASE WHEN f AND th THEN 0.15 WHEN th THEN 0.105 WHEN f THEN 0.03 ELSE 0 END::DOUBLE AS boost FROM g",
)(
    lambda t: authorities(t).groupBy(F.floor(F.col("doc_id") / 7).alias("grp")).agg(F.bool_or(F.col("kind") == "first_party").alias("f"), F.bool_or(F.col("kind").like("third%") | F.col("kind").like("reg%")).alias("th"))
    .select("grp", Q.authority_boost(F.col("f"), F.col("th")).alias("boost"))
)

@query("token_overlap_all")
def _(t):
    return Q.token_links(t("documents").select(F.col("doc_id").alias("source_id"), "text"))


@query("source_independence_all")
def _(t):
    d = t("documents")
    links = Q.token_links(d.select(F.struct("doc_id", "source").alias("source_id"), "text"))
    share = F.avg((F.col("links") > 0).cast("int"))
    one = links.groupBy(F.col("source_id.source").alias("source")).agg(F.count("*").alias("n"), share.alias("share"))
    return one.select("source", "n", even(1 - F.col("share"), 3).alias("independence"), even(-F.least(F.lit(0.15), 0.15 * F.col("share")), 3).alias("penalty"))


@query(
    "source_reuse_penalty",
    """WITH k AS (SELECT DISTINCT company, run_no, kpi_id, url FROM cites), n AS (SELECT company, run_no, greatest(2, CAST(floor(0.25 * count(DISTINCT kpi_id)) AS INT)) AS lim FROM cites GROUP BY 1, 2),
       u AS (SELECT k.company, k.run_no, url, count(*) > any_value(lim) AS over FROM k JOIN n ON k.company = n.company AND k.run_no = n.run_no GROUP BY k.company, k.run_no, url),
       f AS (SELECT c.company, c.run_no, c.kpi_id, avg(CASE WHEN over THEN 1 ELSE 0 END) AS frac FROM cites c JOIN u ON c.company = u.company AND c.run_no = u.run_no AND c.url = u.url GROUP BY 1, 2, 3)
       SELECT company, run_no, kpi_id, round(CASE WHEN frac > 0.5 THEN -least(0.1::DOUBLE, frac * 0.1::DOUBLE) ELSE 0 END, 6) AS penalty FROM f""",
)
def _(t):
    c = t("cites")
    lim = c.groupBy("company", "run_no").agg(F.greatest(F.lit(2), F.floor(0.25 * F.countDistinct("kpi_id"))).alias("lim"))
    u = c.groupBy("company", "run_no", "url").agg(F.countDistinct("kpi_id").alias("k")).join(lim, ["company", "run_no"])
    f = c.join(u.select("company", "run_no", "url", (F.col("k") > F.col("lim")).cast("int").alias("over")), ["company", "run_no", "url"])
    f = f.groupBy("company", "run_no", "kpi_id").agg(F.avg("over").alias("frac"))
    return f.select("company", "run_no", "kpi_id", F.round(F.when(F.col("frac") > 0.5, -F.least(F.lit(0.1), F.col("frac") * 0.1)).otherwise(0.0), 6).alias("penalty"))



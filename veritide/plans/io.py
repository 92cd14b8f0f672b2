"""Queries of readers, writers and scopes: each writes its input in the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veritide.functions.numbers import signed_round
from veritide.operators import scopes, sinks
from veritide.plans.base import ORACLES, QUERIES, query, shared_folder
from veritide.plans.rollups import PILLAR, pillars
from veritide.sources import files


def place(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/veritide-io/{label}-{uuid.uuid4().hex}"


@query(
    "scan_sources_export",
    "WITH p AS (SELECT page_id, trim(url) AS url, trim(html) AS content FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS i FROM p WHERE url <> '' AND content <> '') SELECT substr(sha1(url), 1, 8) AS source_id, url, content, 2 AS tier, '2024-01-02T03:04:05+00:00' AS retrieved_at FROM f WHERE i = 1",
)
def _(t):
    p = t("pages")
    spark, path = p.sparkSession, place(p.sparkSession, "export")
    p.select("url", F.col("html").alias("content"), F.lit("2024-01-02T03:04:05.678").alias("created_at"), F.col("page_id").alias("pos")).write.json(path)
    return files.scan_sources_export(spark, path)


@query("scan_ground_truth", "SELECT concat('point ', item_id) AS name, text AS answer, list_value('https://x.example.com/' || item_id) AS urls FROM benchmark")
def _(t):
    b = t("benchmark")
    path = place(b.sparkSession, "truth")
    i = F.col("item_id").cast("string")
    b.select(F.concat(F.lit(" point "), i).alias("name"), F.col("text").alias("answer"), F.concat(F.lit("see https://x.example.com/"), i, F.lit(").")).alias("sources")).write.json(path)
    return files.scan_ground_truth(b.sparkSession, path)


@query(
    "scan_kpi_csv",
    "SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_' || p_partkey AS kpi_id, p_brand AS pillar, p_type AS question, list_value('1: ' || p_brand, '5: ' || p_type) AS rubric FROM part WHERE p_size % 3 <> 0",
)
def _(t):
    p = t("part")
    path = place(p.sparkSession, "catalog")
    status = F.when(F.col("p_size") % 3 == 0, "draft").when(F.col("p_size") % 3 == 1, "Confirmed").otherwise("")
    p.select(
        F.col("p_partkey").alias("row"), F.col("p_name").alias("name"), F.col("p_brand").alias("pillar"), status.alias("status"), F.lit(" ").alias("question"),
        F.col("p_type").alias("definition"), F.col("p_brand").alias("level_1"), F.col("p_type").alias("level_5"),
    ).write.csv(path, header=True)
    return files.scan_kpi_csv(p.sparkSession, path)


query("convert_kpis", "SELECT p_partkey, list_value('1: ' || p_name, '2: (no criteria defined)', '3: (no criteria defined)', '4: (no criteria defined)', '5: (no criteria defined)') AS rubric FROM part WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '^[0-9]+$')")(
    lambda t: t("part").where(F.col("p_partkey").cast("string").rlike("^[0-9]+$")).select("p_partkey", files.padded_rubric(F.array(F.concat(F.lit("1: "), "p_name"))).alias("rubric"))
)
query("scan_golden_db", "SELECT label AS kpi_id, vec_id AS chunk_id, coalesce(CASE WHEN vec_id % 4 <> 0 THEN vec_id % 3 END, 1.0)::DOUBLE AS relevance FROM embeddings")(
    lambda t: t("embeddings").select(F.col("label").alias("kpi_id"), F.col("vec_id").alias("chunk_id"), F.coalesce(F.when(F.col("vec_id") % 4 != 0, (F.col("vec_id") % 3).cast("double")), F.lit(1.0)).alias("relevance"))
)


@query("scan_golden_yaml", "SELECT r_name AS kpi_id, n_name AS chunk_id, 1.0::DOUBLE AS relevance FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(t):
    from veritide.sources.yaml_source import YamlSource

    r = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    spark, path = r.sparkSession, place(r.sparkSession, "golden")
    entries = F.transform(F.sort_array(F.collect_list("n_name")), lambda n: F.concat(F.lit("  - chunk_id: "), n))
    body = r.groupBy("r_name").agg(F.concat(F.col("r_name"), F.lit(":\n"), F.array_join(entries, "\n")).alias("value"))
    body.select("value").write.text(path, lineSep="\n---\n")
    spark.dataSource.register(YamlSource)
    docs = spark.read.format("yaml_docs").option("extensions", "txt").load(path)
    gold = docs.select(F.explode(F.from_json("body", "map<string,array<struct<chunk_id:string,relevance:double>>>")).alias("kpi_id", "c"))
    one = gold.select("kpi_id", F.explode("c").alias("c"))
    return one.select("kpi_id", "c.chunk_id", F.coalesce("c.relevance", F.lit(1.0)).alias("relevance"))


@query("scan_eval_json", "SELECT company, run_no, row_number() OVER (PARTITION BY company ORDER BY run_no DESC) AS rank, n FROM (SELECT company, run_no, count(*) AS n FROM kr GROUP BY 1, 2)")
def _(t):
    k = t("kr").groupBy("company", "run_no").agg(F.count("*").alias("n"))
    path = place(k.sparkSession, "evals")
    sinks.write_json(k, path)
    back = k.sparkSession.read.schema("company long, run_no int, n long").json(path)
    return files.newest_first(back, "company", "run_no", "n").select("company", "run_no", "rank", "n")


@query("scan_snapshot", "SELECT company, run_no, kpi_id, score, confidence FROM kr")
def _(t):
    k = t("kr").select("company", "run_no", "kpi_id", "score", "confidence")
    path = place(k.sparkSession, "snapshots")
    sinks.write_json(sinks.snapshot(k, ["company", "run_no"], "kpi_id", ["score", "confidence"]), path)
    back = k.sparkSession.read.schema("company long, run_no int, kpis map<string,struct<score:double,confidence:double>>").json(path)
    return back.select("company", "run_no", F.explode("kpis").alias("kpi_id", "v")).select("company", "run_no", "kpi_id", "v.score", "v.confidence")


QUERIES["sink_snapshot"], ORACLES["sink_snapshot"] = QUERIES["scan_snapshot"], ORACLES["scan_snapshot"]


@query("sink_report", f"WITH p AS ({PILLAR}) SELECT company, run_no, count(*) AS n_pillars, round(sum(score), 4) AS total FROM p GROUP BY 1, 2")
def _(t):
    p = pillars(t).drop("kpis")
    k = t("kr").select("company", "run_no", "kpi_id", "score")
    path = place(p.sparkSession, "reports")
    sinks.write_json(sinks.report(k, p, ["company", "run_no"]), path)
    back = p.sparkSession.read.schema("company long, run_no int, pillar_scores array<struct<pillar:string,score:double,confidence:double>>").json(path)
    return back.select("company", "run_no", F.size("pillar_scores").cast("long").alias("n_pillars"), F.round(F.aggregate("pillar_scores", F.lit(0.0), lambda s, x: s + x["score"]), 4).alias("total"))


@query("sink_eval_json", "SELECT company, run_no, kpi_id, live_score FROM kr WHERE live_score IS NOT NULL")
def _(t):
    k = t("kr").where("live_score IS NOT NULL").select("company", "run_no", "kpi_id", "live_score")
    path = place(k.sparkSession, "evals")
    sinks.write_json(k, path)
    return k.sparkSession.read.schema("company long, run_no int, kpi_id string, live_score double").json(path)


@query("sink_attribution_state", "SELECT company, kpi_id, arg_max(run_no, run_no) AS run_no, arg_max(score, run_no) AS score FROM kr WHERE run_no IN (1, 2) GROUP BY 1, 2")
def _(t):
    k = t("kr").select("company", "kpi_id", "run_no", "score")
    spark, path = k.sparkSession, place(k.sparkSession, "state")
    k.where("run_no = 1").write.parquet(f"{path}/0")
    sinks.upsert(spark.read.schema(k.schema).parquet(f"{path}/0"), k.where("run_no = 2"), ["company", "kpi_id"]).write.parquet(f"{path}/1")
    return spark.read.schema(k.schema).parquet(f"{path}/1")


@query("sink_vector_index", "SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings")
def _(t):
    e = t("embeddings")
    path = place(e.sparkSession, "index")
    e.write.partitionBy("label").parquet(path)
    return e.sparkSession.read.parquet(path).select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: signed_round(x.cast("double"), 6)).alias("v"))


query("sink_run_log", "SELECT concat(company, '-', run_no) AS run, x.k AS key, x.t AS kind, x.v AS value FROM (SELECT company, run_no, unnest([{'k': 'kpi_id', 't': 'param', 'v': kpi_id}, {'k': 'n', 't': 'metric', 'v': CAST(n AS VARCHAR)}]) AS x FROM kr)")(
    lambda t: sinks.run_log(t("kr").withColumn("run", F.concat_ws("-", F.col("company").cast("string"), F.col("run_no").cast("string"))), "run", ["kpi_id"], ["n"])
)
query("typed_eq", "SELECT o_orderkey FROM orders WHERE o_custkey = 42")(lambda t: t("orders").where(scopes.typed_eq(t("orders"), "o_custkey", "42")).select("o_orderkey"))


@query("choose_run_column", "SELECT 'o_custkey' AS col, count(*) AS n FROM orders WHERE o_custkey = 42")
def _(t):
    o = t("orders")
    col, value = scopes.choose_column(o, [("o_orderkey", "42"), ("o_custkey", "42"), ("missing", "1")])
    return o.where(scopes.typed_eq(o, col, value)).agg(F.lit(col).alias("col"), F.count("*").alias("n"))


query("resolve_run_id", "SELECT event_id, regexp_replace(md5(CAST(event_id AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS run_key FROM events")(
    lambda t: scopes.resolve_run(t("events").withColumn("run_uuid", F.upper(F.md5(F.col("event_id").cast("string")))), "request_id", "run_uuid").select("event_id", "run_key")
)


RUN_LIKE = "(SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1)"


def one_run(t, keyed: bool):
    """The scores and sources of the order with the smallest key, looked up by its key or by a request id."""
    o, li, c = t("orders"), t("lineitem"), t("customer")
    first = o.orderBy("o_orderkey").first().o_orderkey
    runs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("req-"), F.col("o_orderkey").cast("string")).alias("request_id"), F.col("o_custkey").alias("company_id"))
    scores = li.select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("kpi_"), F.col("l_partkey").cast("string")).alias("kpi_id"), F.round("l_extendedprice", 2).alias("score"))
    sources = li.select(F.concat(F.lit("req-"), F.col("l_orderkey").cast("string")).alias("request_id"), F.col("l_suppkey").alias("source_id"))
    companies = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return files.load_run(runs, scores, sources, companies, f"req-{first}" if keyed else str(first))


query(
    "scan_postgres_run",
    f"SELECT 'kpi_' || l_partkey AS kpi_id, round(l_extendedprice, 2) AS score, c_name AS company FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_orderkey = {RUN_LIKE}",
)(lambda t: one_run(t, False)[0].select("kpi_id", "score", "company"))
query(
    "scan_postgres_sources",
    f"SELECT l_suppkey AS source_id, c_name AS company FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_orderkey = {RUN_LIKE}",
)(lambda t: one_run(t, True)[1].select("source_id", "company"))

REPORTS = "SELECT concat(company, '-', run_no) AS run_id, concat('2024-01-0', run_no + 1) AS timestamp, CAST(company AS VARCHAR) AS company, round(avg(score), 6) AS overall_score FROM kr GROUP BY kr.company, kr.run_no"


@query("scan_report_yaml", f"SELECT *, row_number() OVER (ORDER BY timestamp DESC, run_id DESC) AS rank FROM ({REPORTS})")
def _(t):
    text = lambda c: F.col(c).cast("string")
    k = t("kr").groupBy("company", "run_no").agg(F.round(F.avg("score"), 6).alias("overall_score"), F.sort_array(F.collect_list(F.struct("kpi_id", "score"))).alias("kpis"))
    reports = k.select(
        F.concat_ws("-", text("company"), text("run_no")).alias("run_id"), F.concat(F.lit("2024-01-0"), (F.col("run_no") + 1).cast("string")).alias("timestamp"),
        text("company").alias("company"), "overall_score", "kpis",
    )
    path = place(k.sparkSession, "yaml")
    sinks.write_yaml(reports, path, "run_id")
    return files.scan_reports(k.sparkSession, path).drop("file")


query(
    "sink_trace",
    """SELECT concat(company, ':', run_no, ':', kpi_id) AS trace, x.k AS kind, x.n AS name, x.v AS value, first_event AS at FROM (SELECT *, unnest([{'k': 'score', 'n': 'confidence', 'v': CAST(CAST(confidence AS DOUBLE) AS VARCHAR)},
       {'k': 'span', 'n': 'pillar', 'v': pillar}, {'k': 'event', 'n': 'low_confidence', 'v': CASE WHEN confidence < 0.3 THEN 'true' END}]) AS x FROM kr) WHERE x.v IS NOT NULL""",
)(
    lambda t: sinks.trace_events(
        t("kr").withColumn("trace", F.concat_ws(":", F.col("company").cast("string"), F.col("run_no").cast("string"), "kpi_id")),
        "trace", F.col("first_event"), ["confidence"], {"low_confidence": F.col("confidence") < 0.3}, ["pillar"],
    )
)

"""Registration of queries with their SQL twins, and the inputs that they derive from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritide.functions.text import STOP, STOP_CLAIMS
from veritide.sources.tables import read_table, shared_folder  # noqa: F401

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(t)``, where t(name) reads a table; sql may use the shared views below."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: table_of(spark, sf_dir, table))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def t1(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


def t2(c: str, stop=STOP) -> str:
    return f"list_filter({t1(c)}, lambda w: length(w) > 2 AND w NOT IN ({quoted(stop)}))"


def t4(c: str) -> str:
    return f"list_distinct(list_filter({t1(c)}, lambda w: length(w) >= 4 AND w NOT IN ({quoted(STOP_CLAIMS)})))"


def t56(c: str, least: int) -> str:
    return f"list_distinct(list_filter({t1(c)}, lambda w: length(w) >= {least}))"


def sents(c: str) -> str:
    marked = rf"regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


#: Views that queries and SQL share.  A KPI result is made of a user's events of one type in one week.
VIEWS = {
    "kr": """
        SELECT user_id % 20 AS company, CAST(floor((day(ts) - 1) / 7) AS INT) AS run_no,
               concat(event_type, '_', CAST(user_id % 6 AS VARCHAR)) AS kpi_id, event_type AS pillar,
               1 + (sum(CAST(round(value * 100) AS BIGINT)) % 401) / 100.0 AS score,
               (count(*) * 13 % 101) / 100.0 AS confidence,
               CASE WHEN min(event_id) % 3 = 0 THEN 1 + (max(event_id) % 401) / 100.0 END AS live_score,
               count(*) AS n, min(event_id) AS first_event
        FROM events GROUP BY 1, 2, 3, 4
    """,
    "cites": r"""
        SELECT user_id % 20 AS company, CAST(floor((day(ts) - 1) / 7) AS INT) AS run_no,
               concat(event_type, '_', CAST(user_id % 6 AS VARCHAR)) AS kpi_id, event_type AS pillar, event_id AS pos,
               concat('s', CAST(CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 30 AS VARCHAR)) AS source_id,
               concat('https://', CASE WHEN user_id % 4 = 0 THEN 'investor.' ELSE 'www.' END, 'd',
                      CAST(CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 7 AS VARCHAR), '.example.com/p/',
                      CAST(CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 30 AS VARCHAR)) AS url,
               CAST(1 + CAST(regexp_extract(props, '(\d+)', 1) AS INT) % 3 AS INT) AS tier, value, ts
        FROM events
    """,
    "qa": """
        SELECT u.conv_id AS qid, u.turn AS turn, u.text AS question, a.text AS answer
        FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'
    """,
    "ctx": """
        SELECT q.qid, q.turn, c.turn AS pos, c.text AS context
        FROM qa q JOIN conversations c ON c.conv_id = q.qid AND c.turn <> q.turn AND c.turn <> q.turn + 1
    """,
    "rag": """
        SELECT q.qid, q.turn, q.question, q.answer, i.text AS truth
        FROM qa q LEFT JOIN items i ON i.r = q.qid % i.n
    """,
    "items": """
        SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS r, count(*) OVER () AS n FROM benchmark
    """,
}


def even_sql(sql: str) -> str:
    """``round_even(x, d)`` on the decimal value of x to nine digits, like ``functions.numbers.even``."""
    out, name = "", "round_even("
    while (at := sql.find(name)) >= 0:
        depth, comma, end = 1, 0, at + len(name)
        while depth:
            c = sql[end]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = even_sql(sql[at + len(name) : comma]), sql[comma + 1 : end - 1].strip()
        out += f"{sql[:at]}CAST(round_even(CAST({inner} AS DECIMAL(18,9)), {digits}) AS DOUBLE)"
        sql = sql[end:]
    return out + sql


def with_views(sql: str) -> str:
    import re

    sql = even_sql(sql)

    used: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if v not in used and re.search(rf"\b(FROM|JOIN)\s+{v}\b", text):
                need(VIEWS[v])
                if v not in used:
                    used.append(v)

    need(sql)
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def _kr(t) -> DataFrame:
    e = t("events")
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return e.groupBy(
        (F.col("user_id") % 20).alias("company"), week.alias("run_no"),
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 6).cast("string")).alias("kpi_id"), F.col("event_type").alias("pillar"),
    ).agg(
        (1 + (cents % 401) / 100.0).alias("score"), ((F.count("*") * 13 % 101) / 100.0).alias("confidence"),
        F.when(F.min("event_id") % 3 == 0, 1 + (F.max("event_id") % 401) / 100.0).alias("live_score"),
        F.count("*").alias("n"), F.min("event_id").alias("first_event"),
    )


def _cites(t) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    page = (k % 30).cast("string")
    prefix = F.when(F.col("user_id") % 4 == 0, "investor.").otherwise("www.")
    return t("events").select(
        (F.col("user_id") % 20).alias("company"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("run_no"),
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 6).cast("string")).alias("kpi_id"), F.col("event_type").alias("pillar"),
        F.col("event_id").alias("pos"), F.concat(F.lit("s"), page).alias("source_id"),
        F.concat(F.lit("https://"), prefix, F.lit("d"), (k % 7).cast("string"), F.lit(".example.com/p/"), page).alias("url"),
        (1 + k % 3).cast("int").alias("tier"), "value", "ts",
    )


def _qa(t) -> DataFrame:
    c = t("conversations")
    u = c.where("role = 'user'").select(F.col("conv_id").alias("qid"), "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("answer"))
    return u.join(a, (F.col("qid") == F.col("_c")) & (F.col("turn") == F.col("_t"))).drop("_c", "_t")


def _ctx(t) -> DataFrame:
    q = _qa(t).select("qid", "turn")
    c = t("conversations").select(F.col("conv_id").alias("_c"), F.col("turn").alias("pos"), F.col("text").alias("context"))
    near = (F.col("pos") != F.col("turn")) & (F.col("pos") != F.col("turn") + 1)
    return q.join(c, (F.col("qid") == F.col("_c")) & near).drop("_c")


def _items(t) -> DataFrame:
    """The benchmark's items with their place r and their number n, so that rows are dealt over all of them."""
    b = t("benchmark")
    return b.select("item_id", "text", (F.row_number().over(Window.orderBy("item_id")) - 1).alias("r"), F.lit(b.count()).alias("n"))


def _rag(t) -> DataFrame:
    i = _items(t).select("r", "n", F.col("text").alias("truth"))
    return _qa(t).join(i, F.col("r") == F.col("qid") % F.col("n"), "left").drop("r", "n")


_MADE = {"kr": _kr, "cites": _cites, "qa": _qa, "ctx": _ctx, "rag": _rag, "items": _items}


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in _MADE:
        return _MADE[name](lambda other: table_of(spark, sf_dir, other))
    return read_table(spark, sf_dir, name)

"""Queries of answer-quality metrics on question, answer, contexts and ideal answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritide.functions.numbers import even
from veritide.functions import text as T
from veritide.plans.base import query, sents, t2

W = f"""w AS (SELECT qid, turn, question, answer, truth, list_distinct({t2('question')}) AS q, list_distinct({t2('answer')}) AS a,
        list_distinct({t2("coalesce(truth, '')")}) AS g FROM rag),
    cw AS (SELECT qid, turn, pos, list_distinct({t2('context')}) AS c FROM ctx),
    ev AS (SELECT qid, turn, list_distinct(flatten(list(c))) AS c FROM cw GROUP BY qid, turn),
    m AS (SELECT w.*, coalesce(ev.c, []) AS c FROM w LEFT JOIN ev ON w.qid = ev.qid AND w.turn = ev.turn)"""
K = "qid, turn"


def base(t):
    """(qid, turn, ..., q, a, g, c): distinct words of question, answer, ideal answer and all contexts."""
    c = t("ctx").select("qid", "turn", "pos", F.array_distinct(T.metric_words(F.col("context"))).alias("c"))
    ev = c.groupBy("qid", "turn").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("c"))
    none = F.array().cast("array<string>")
    q, a, g = (F.array_distinct(T.metric_words(F.col(c))) for c in ("question", "answer", "truth"))
    rag = t("rag").withColumns({"q": q, "a": a, "g": F.coalesce(g, none)})
    return rag.join(ev, ["qid", "turn"], "left").withColumn("c", F.coalesce("c", none))


@query(
    "ragas_local",
    f"""WITH {W}, p AS (SELECT cw.qid, cw.turn, avg(CASE WHEN len(cw.c) > 0 THEN len(list_intersect(w.q, cw.c))::DOUBLE / len(cw.c) END) AS p
            FROM cw JOIN w ON cw.qid = w.qid AND cw.turn = w.turn GROUP BY cw.qid, cw.turn)
        SELECT m.qid, m.turn, round_even(len(list_intersect(a, c))::DOUBLE / greatest(len(a), 1), 3) AS faithfulness,
               round_even(len(list_intersect(q, a))::DOUBLE / greatest(len(q), 1), 3) AS relevancy, round_even(coalesce(p.p, 0), 3) AS precision,
               CASE WHEN truth IS NOT NULL THEN round_even(len(list_intersect(g, c))::DOUBLE / greatest(len(g), 1), 3) END AS recall
        FROM m LEFT JOIN p ON p.qid = m.qid AND p.turn = m.turn""",
)
def _(t):
    b = base(t)
    c = t("ctx").select("qid", "turn", F.array_distinct(T.metric_words(F.col("context"))).alias("one"))
    share = F.when(F.size("one") > 0, F.size(F.array_intersect("q", "one")) / F.size("one"))
    p = b.select("qid", "turn", "q").join(c, ["qid", "turn"]).groupBy("qid", "turn").agg(F.avg(share).alias("p"))
    return b.join(p, ["qid", "turn"], "left").select(
        "qid", "turn",
        even(T.overlap(F.col("a"), F.col("c")), 3).alias("faithfulness"),
        even(T.overlap(F.col("q"), F.col("a")), 3).alias("relevancy"),
        even(F.coalesce("p", F.lit(0.0)), 3).alias("precision"),
        F.when(F.col("truth").isNotNull(), even(T.overlap(F.col("g"), F.col("c")), 3)).alias("recall"),
    )


@query(
    "f1_overlap",
    f"""WITH x AS (SELECT qid, turn, {t2('answer')} AS a, {t2("coalesce(truth, '')")} AS g FROM rag),
        ta AS (SELECT qid, turn, w, count(*) AS n FROM (SELECT qid, turn, unnest(a) AS w FROM x) GROUP BY ALL),
        tg AS (SELECT qid, turn, w, count(*) AS n FROM (SELECT qid, turn, unnest(g) AS w FROM x) GROUP BY ALL),
        s AS (SELECT ta.qid, ta.turn, sum(least(ta.n, tg.n)) AS s FROM ta JOIN tg ON ta.qid = tg.qid AND ta.turn = tg.turn AND ta.w = tg.w GROUP BY ALL),
        v AS (SELECT x.qid, x.turn, len(a) AS na, len(g) AS ng, coalesce(s, 0) AS shared FROM x LEFT JOIN s ON x.qid = s.qid AND x.turn = s.turn)
        SELECT qid, turn, CAST(shared AS BIGINT) AS shared, round_even(shared::DOUBLE / greatest(na, 1), 3) AS p, round_even(shared::DOUBLE / greatest(ng, 1), 3) AS r,
               round_even(CASE WHEN shared = 0 THEN 0 ELSE 2.0::DOUBLE * shared / (na + ng) END, 3) AS f1 FROM v""",
)
def _(t):
    x = t("rag").select("qid", "turn", T.metric_words(F.col("answer")).alias("a"), T.metric_words(F.coalesce("truth", F.lit(""))).alias("g"))
    count = lambda c, n: x.select("qid", "turn", F.explode(c).alias("w")).groupBy("qid", "turn", "w").agg(F.count("*").alias(n))
    s = count("a", "na").join(count("g", "ng"), ["qid", "turn", "w"]).groupBy("qid", "turn").agg(F.sum(F.least("na", "ng")).alias("s"))
    na, ng, shared = F.size("a"), F.size("g"), F.coalesce("s", F.lit(0))
    return x.join(s, ["qid", "turn"], "left").select(
        "qid", "turn", shared.alias("shared"), even(shared / F.greatest(na, F.lit(1)), 3).alias("p"),
        even(shared / F.greatest(ng, F.lit(1)), 3).alias("r"),
        even(F.when(shared == 0, 0.0).otherwise(2.0 * shared / (na + ng)), 3).alias("f1"),
    )


def _sentence_share(t, least: int, against: str, share: float):
    """Sentences of the answer with ``least`` words and more: (n, those whose words are found in ``against`` to ``share``)."""
    b = base(t).select("qid", "turn", against, F.explode_outer(T.sentences(F.col("answer"))).alias("s"))
    b = b.withColumn("ok", F.size(F.split("s", r"\s+")) >= least)
    w = F.array_distinct(T.metric_words(F.col("s")))
    found = (F.size(w) == 0) | (F.size(F.array_intersect(w, against)) / F.size(w) >= share)
    return b.groupBy("qid", "turn").agg(
        F.count_if("ok").alias("n"), F.count_if(F.col("ok") & found).alias("hit"),
    )


def _sentence_sql(least: int, against: str, share: float) -> str:
    return f"""WITH {W}, s AS (SELECT qid, turn, {against} AS e, unnest({sents('answer')}) AS s FROM m),
        x AS (SELECT qid, turn, e, list_distinct({t2('s')}) AS w FROM s WHERE len(regexp_split_to_array(s, '\\s+')) >= {least}),
        v AS (SELECT qid, turn, count(*) AS n, count(*) FILTER (WHERE len(w) = 0 OR len(list_intersect(w, e))::DOUBLE / len(w) >= {share}) AS hit FROM x GROUP BY qid, turn),
        r AS (SELECT m.qid, m.turn, coalesce(n, 0) AS n, coalesce(hit, 0) AS hit FROM m LEFT JOIN v ON m.qid = v.qid AND m.turn = v.turn)"""


@query(
    "hallucination",
    _sentence_sql(5, "c", 0.2)
    + " SELECT qid, turn, n AS sentences, n - hit AS unsupported, round_even((n - hit)::DOUBLE / greatest(n, 1), 3) AS score, round_even((n - hit)::DOUBLE / greatest(n, 1), 3) > 0.4 AS flagged FROM r",
)
def _(t):
    bad = F.col("n") - F.col("hit")
    score = even(bad / F.greatest("n", F.lit(1)), 3)
    return _sentence_share(t, 5, "c", 0.2).select("qid", "turn", F.col("n").alias("sentences"), bad.alias("unsupported"), score.alias("score"), (score > 0.4).alias("flagged"))


@query("factual_correctness", _sentence_sql(4, "g", 0.3) + " SELECT qid, turn, round_even(hit::DOUBLE / greatest(n, 1), 3) AS score FROM r")
def _(t):
    return _sentence_share(t, 4, "g", 0.3).select("qid", "turn", even(F.col("hit") / F.greatest("n", F.lit(1)), 3).alias("score"))


@query(
    "noise_sensitivity",
    f"""WITH {W} SELECT qid, turn, round_even(least(1, greatest(0, (len(list_intersect(a, c)) - len(list_intersect(a, g)))::DOUBLE / greatest(len(a), 1))), 3) AS score FROM m""",
)
def _(t):
    diff = (F.size(F.array_intersect("a", "c")) - F.size(F.array_intersect("a", "g"))) / F.greatest(F.size("a"), F.lit(1))
    return base(t).select("qid", "turn", even(F.least(F.lit(1.0), F.greatest(F.lit(0.0), diff)), 3).alias("score"))


@query(
    "semantic_similarity",
    f"""WITH tok AS (SELECT qid, turn, 0 AS side, unnest({t2('answer')}) AS w FROM rag UNION ALL SELECT qid, turn, 1, unnest({t2("coalesce(truth, '')")}) FROM rag),
        e AS (SELECT qid, turn, side, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INT) AS b, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS x FROM tok GROUP BY ALL),
        n AS (SELECT qid, turn, side, sqrt(sum(x * x)::DOUBLE) AS n FROM e GROUP BY ALL),
        d AS (SELECT a.qid, a.turn, sum(a.x * b.x)::DOUBLE AS d FROM e a JOIN e b ON a.qid = b.qid AND a.turn = b.turn AND a.b = b.b AND a.side = 0 AND b.side = 1 GROUP BY ALL)
        SELECT r.qid, r.turn, round_even((coalesce(d.d / nullif(x.n * y.n, 0), 0) + 1) / 2, 3) AS score FROM rag r LEFT JOIN d ON r.qid = d.qid AND r.turn = d.turn
        LEFT JOIN n x ON x.qid = r.qid AND x.turn = r.turn AND x.side = 0 LEFT JOIN n y ON y.qid = r.qid AND y.turn = r.turn AND y.side = 1""",
)
def _(t):
    def embedded(c, name):
        w = t("rag").select("qid", "turn", F.explode(T.metric_words(F.coalesce(c, F.lit("")))).alias("w"))
        return w.groupBy("qid", "turn", T.bucket(F.col("w"), 64).alias("b")).agg(F.sum(T.sign(F.col("w"))).alias(name))

    x, y = embedded("answer", "x"), embedded("truth", "y")
    both = x.join(y, ["qid", "turn", "b"], "full").groupBy("qid", "turn").agg(
        F.sum(F.col("x") * F.col("y")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy")
    )
    cos = F.coalesce(F.try_divide(F.col("d").cast("double"), F.sqrt(F.col("xx").cast("double")) * F.sqrt(F.col("yy").cast("double"))), F.lit(0.0))
    return t("rag").select("qid", "turn").join(both, ["qid", "turn"], "left").select("qid", "turn", even((cos + 1) / 2, 3).alias("score"))


@query(
    "context_build",
    """WITH o AS (SELECT qid, turn, pos, substr(context, 1, 500) AS c, row_number() OVER (PARTITION BY qid, turn ORDER BY pos) AS r FROM ctx)
       SELECT qid, turn, array_to_string(list(c ORDER BY pos), chr(2)) AS contexts, list(concat(qid, '::chunk_', pos) ORDER BY pos) AS ids FROM o WHERE r <= 5 GROUP BY qid, turn""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("qid", "turn").orderBy("pos")
    c = t("ctx").withColumn("r", F.row_number().over(w)).where("r <= 5")
    one = F.struct("pos", F.substring("context", 1, 500).alias("c"), F.concat(F.col("qid").cast("string"), F.lit("::chunk_"), F.col("pos").cast("string")).alias("i"))
    l = F.sort_array(F.collect_list(one))
    return c.groupBy("qid", "turn").agg(F.array_join(l["c"], "\x02").alias("contexts"), l["i"].alias("ids"))


@query(
    "evaluate_kpi",
    f"""WITH {W} SELECT qid, turn, round_even(len(list_intersect(a, c))::DOUBLE / greatest(len(a), 1), 3) AS faithfulness,
        round_even(len(list_intersect(q, a))::DOUBLE / greatest(len(q), 1), 3) AS relevancy, CAST(NULL AS DOUBLE) AS judge, CAST(NULL AS DOUBLE) AS bertscore FROM m""",
)
def _(t):
    none = F.lit(None).cast("double")
    return base(t).select("qid", "turn", even(T.overlap(F.col("a"), F.col("c")), 3).alias("faithfulness"), even(T.overlap(F.col("q"), F.col("a")), 3).alias("relevancy"), none.alias("judge"), none.alias("bertscore"))


REPORT = f"""WITH {W}, v AS (SELECT round_even(len(list_intersect(a, c))::DOUBLE / greatest(len(a), 1), 3) AS f FROM m),
    s AS (SELECT count(*) AS n, count(*) FILTER (WHERE f < 0.6) AS flagged, round(avg(f), 6) AS avg_f FROM v)
    SELECT n, flagged, avg_f, CASE WHEN flagged = 0 THEN 'all grounded' WHEN flagged::DOUBLE / n <= 0.2 THEN 'mostly grounded' ELSE 'needs review' END AS verdict FROM s"""


@query("rag_report", REPORT)
def _(t):
    f = base(t).select(even(T.overlap(F.col("a"), F.col("c")), 3).alias("f"))
    s = f.agg(F.count("*").alias("n"), F.count_if(F.col("f") < 0.6).alias("flagged"), F.round(F.avg("f"), 6).alias("avg_f"))
    text = F.when(F.col("flagged") == 0, "all grounded").when(F.col("flagged") / F.col("n") <= 0.2, "mostly grounded").otherwise("needs review")
    return s.withColumn("verdict", text)

"""Queries over evidence lists: what is retrieved for a benchmark question is judged as one group.

A question's evidence is its ten best documents by hash embeddings; the scoring queries cut it to three.
Groups are thus bounded by the retrieval depth, whatever the corpus holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritide.functions import text as T
from veritide.functions.numbers import even
from veritide.operators import retrieval as R
from veritide.operators import scoring as S
from veritide.operators import source_quality as Q
from veritide.functions.text import STOP_CLAIMS
from veritide.plans.base import query, quoted, sents, shared_folder, t2, t4, t56
from veritide.plans.retrieval import SEM, semantic

OWN = "example.com"
HOST = "CASE doc_id % 6 WHEN 0 THEN 'www.example.com' WHEN 1 THEN 'news.reuters.com' WHEN 2 THEN 'gartner.com' WHEN 3 THEN 'eur.europa.eu' ELSE source || '.net' END"
LEAF = "CASE WHEN doc_id % 7 = 0 THEN 'report' WHEN doc_id % 5 = 0 THEN 'blog' ELSE 'x' END"


def url_of(doc):
    """The documents' stand-in URLs: hosts of known and unknown authority, some of telling paths."""
    m = doc % 6
    host = F.when(m == 0, "www.example.com").when(m == 1, "news.reuters.com").when(m == 2, "gartner.com").when(m == 3, "eur.europa.eu").otherwise(F.concat("source", F.lit(".net")))
    leaf = F.when(doc % 7 == 0, "report").when(doc % 5 == 0, "blog").otherwise("x")
    return F.concat(F.lit("https://"), host, F.lit("/"), leaf)


def evidence(t, depth: int = 10):
    """(grp, rank, source_id, text, url) of the first ``depth`` documents of each question, held in the shared folder."""
    spark = t("benchmark").sparkSession
    path = f"{shared_folder(spark)}/veritide-evidence/{uuid.uuid4().hex}"
    found = semantic(t).select(F.col("q").alias("grp"), "id", "rank", "score")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    d = t("documents").select(F.col("doc_id").alias("source_id"), "text", url_of(F.col("doc_id")).alias("url"))
    return found.where(F.col("rank") <= depth).join(d, F.col("id") == F.col("source_id")).select("grp", "rank", "source_id", "score", "text", "url")


def ev_sql(depth: int = 10) -> str:
    return f"""{SEM}, ev AS MATERIALIZED (SELECT sem.q AS grp, sem.rank, d.doc_id AS source_id, d.text, concat('https://', {HOST}, '/', {LEAF}) AS url
        FROM sem JOIN documents d ON d.doc_id = sem.id WHERE sem.rank <= {depth}),
        src AS MATERIALIZED (SELECT DISTINCT source_id, text, url FROM ev), n AS (SELECT grp, count(*) AS n FROM ev GROUP BY grp)"""


# Claims and corroboration

CLAIM_SQL = f"""s0 AS (SELECT source_id, unnest({sents('text')}) AS raw, generate_subscripts({sents('text')}, 1) - 1 AS pos FROM src),
    c0 AS (SELECT source_id, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS claim FROM s0),
    k0 AS (SELECT *, row_number() OVER (PARTITION BY source_id, substr(lower(claim), 1, 60) ORDER BY pos) AS i FROM c0 WHERE length(claim) BETWEEN 30 AND 500
          AND NOT regexp_matches(lower(claim), '{"|".join(Q.NO_CLAIM)}') AND regexp_matches(lower(claim), '{"|".join(Q.CLAIM_WORDS)}')),
    g AS MATERIALIZED (SELECT ev.grp, k.source_id, pos, claim FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS m FROM k0 WHERE i = 1) k JOIN ev ON ev.source_id = k.source_id WHERE m <= 30),
    tk AS (SELECT grp, source_id, pos, w, count(*) AS c FROM (SELECT grp, source_id, pos, unnest({t2('claim', STOP_CLAIMS)}) AS w FROM g) GROUP BY ALL),
    sz AS (SELECT grp, source_id, pos, sum(c) AS n FROM tk GROUP BY ALL),
    tn AS MATERIALIZED (SELECT tk.*, n FROM tk JOIN sz ON tk.grp = sz.grp AND tk.source_id = sz.source_id AND tk.pos = sz.pos),
    ov AS (SELECT x.grp, x.source_id AS a, x.pos AS pa, y.source_id AS b, y.pos AS pb, x.n AS na, y.n AS nb, sum(least(x.c, y.c)) AS s
           FROM tn x JOIN tn y ON x.grp = y.grp AND x.w = y.w AND x.source_id < y.source_id GROUP BY ALL),
    p AS MATERIALIZED (SELECT ov.grp, a, b, pa, pb, CAST(round(least(1.0::DOUBLE, s::DOUBLE / (na + nb - s) + least(0.15::DOUBLE, 0.05::DOUBLE * len(list_intersect(
           list_distinct(regexp_extract_all(u.claim, '\\d+\\.?\\d*')), list_distinct(regexp_extract_all(v.claim, '\\d+\\.?\\d*')))))), 6) AS DOUBLE) AS sim
           FROM ov JOIN g u ON u.grp = ov.grp AND u.source_id = a AND u.pos = pa JOIN g v ON v.grp = ov.grp AND v.source_id = b AND v.pos = pb),
    pairs AS (SELECT * FROM p WHERE sim >= 0.35), kk AS (SELECT grp, count(*) AS k FROM pairs GROUP BY grp),
    mm AS (SELECT grp, count(DISTINCT s) AS m FROM (SELECT grp, a AS s FROM pairs UNION ALL SELECT grp, b FROM pairs) GROUP BY grp),
    corr AS (SELECT n.grp, n.n AS sources, coalesce(k, 0) AS pairs, CASE WHEN n.n < 2 THEN 0::DOUBLE WHEN coalesce(k, 0) = 0 THEN round_even(least(0.3::DOUBLE, 0.1::DOUBLE * n.n), 2)
        ELSE round_even(least(0.5::DOUBLE, 0.08::DOUBLE * k) + least(0.5::DOUBLE, 0.12::DOUBLE * m), 2) END AS score FROM n LEFT JOIN kk ON kk.grp = n.grp LEFT JOIN mm ON mm.grp = n.grp)"""


def claims(e):
    """The claims of each group's sources; a source's claims are extracted once for all its groups."""
    of = Q.extract_claims(e.select("source_id", "text").distinct(), "source_id", "text")
    return e.select("grp", "source_id").join(of, "source_id")


def corroborated(e):
    """(grp, sources, pairs, score)."""
    p = Q.claim_pairs(claims(e))
    k = p.select("grp", F.explode(F.array("a", "b")).alias("s")).groupBy("grp").agg(F.countDistinct("s").alias("m"), (F.count("*") / 2).cast("long").alias("k"))
    n = e.groupBy("grp").agg(F.count("*").alias("sources")).join(k, "grp", "left")
    pairs = F.coalesce("k", F.lit(0))
    return n.select("grp", "sources", pairs.alias("pairs"), Q.corroboration(F.col("sources"), pairs, F.coalesce("m", F.lit(0))).alias("score"))


query("claim_similarity", f"WITH {ev_sql()}, {CLAIM_SQL} SELECT grp, a, b, pa, pb, sim FROM p WHERE sim >= 0.2")(lambda t: Q.claim_pairs(claims(evidence(t)), 0.2))
query("claim_pair_join", f"WITH {ev_sql()}, {CLAIM_SQL} SELECT grp, a, b, pa, pb, sim FROM pairs")(lambda t: Q.claim_pairs(claims(evidence(t))))
query("semantic_corroboration", f"WITH {ev_sql()}, {CLAIM_SQL} SELECT grp, sources, pairs, score FROM corr")(lambda t: corroborated(evidence(t)))

KEYWORDS = r"""list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND w NOT IN (STOPS)),
    lambda w: regexp_replace(w, '^[.,!?:;"''()\[\]{}]+|[.,!?:;"''()\[\]{}]+$', '', 'g')))""".replace("STOPS", quoted(T.STOP_KEYWORDS))
KW = f"""kw AS (SELECT grp, source_id, unnest({KEYWORDS}) AS w FROM ev),
    o AS (SELECT grp, w, count(DISTINCT source_id) AS n FROM kw GROUP BY grp, w HAVING count(DISTINCT source_id) >= 3)"""


def shared_keywords(e):
    w = e.select("grp", "source_id", F.explode(T.keywords(F.col("text"))).alias("w"))
    return w.groupBy("grp", "w").agg(F.countDistinct("source_id").alias("n")).where("n >= 3")


query("keyword_overlap", f"WITH {ev_sql()}, {KW} SELECT grp, w, n FROM o")(lambda t: shared_keywords(evidence(t)))


@query(
    "corroboration_v1",
    f"""WITH {ev_sql()}, {KW}, k AS (SELECT grp, count(*) AS k FROM o GROUP BY grp)
        SELECT n.grp, CASE WHEN n.n < 3 THEN 0::DOUBLE ELSE least(1::DOUBLE, round_even(least(0.5::DOUBLE, 0.15::DOUBLE + 0.1::DOUBLE * n.n) + least(0.5::DOUBLE, 0.1::DOUBLE * coalesce(k, 0)), 2)) END AS score FROM n LEFT JOIN k ON k.grp = n.grp""",
)
def _(t):
    e = evidence(t)
    k = shared_keywords(e).groupBy("grp").agg(F.count("*").alias("k"))
    s = e.groupBy("grp").agg(F.count("*").alias("n")).join(k, "grp", "left")
    score = even(F.least(F.lit(0.5), 0.15 + 0.1 * F.col("n")) + F.least(F.lit(0.5), 0.1 * F.coalesce("k", F.lit(0))), 2)
    return s.select("grp", F.when(F.col("n") < 3, 0.0).otherwise(F.least(F.lit(1.0), score)).alias("score"))


@query(
    "corroboration_details",
    f"WITH {ev_sql()}, {KW} SELECT grp, count(*) AS shared, list(w ORDER BY n DESC, w)[1:10] AS first, count(*) >= 30 AS strong FROM o GROUP BY grp",
)
def _(t):
    l = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "w")))
    return shared_keywords(evidence(t)).groupBy("grp").agg(F.count("*").alias("shared"), F.slice(l["w"], 1, 10).alias("first"), (F.count("*") >= 30).alias("strong"))


# Contradictions and independence

CONTRA = (
    "m AS ("
    + " UNION ALL ".join(
        f"SELECT grp, source_id AS s, {i} AS p, '{side}' AS side, substr(regexp_extract(lower(text), '{pat}', 0), 1, 150) AS claim FROM ev WHERE regexp_matches(lower(text), '{pat}')"
        for i, pair in enumerate(Q.CONTRADICTIONS)
        for side, pat in zip(("pos", "neg"), pair, strict=True)
    )
    + "), x AS (SELECT x.grp, x.s AS a, y.s AS b, x.p, x.claim AS claim_a, y.claim AS claim_b FROM m x JOIN m y ON x.grp = y.grp AND x.p = y.p AND x.side = 'pos' AND y.side = 'neg' AND x.s <> y.s),"
    " c AS (SELECT grp, a, b, claim_a, claim_b FROM (SELECT *, row_number() OVER (PARTITION BY grp, a, b, substr(claim_a, 1, 50) ORDER BY p, claim_a, claim_b) AS i FROM x) WHERE i = 1),"
    " cp AS (SELECT grp, count(*) AS n, round_even(-least(0.2::DOUBLE, 0.07::DOUBLE * count(*)), 3) AS penalty FROM c GROUP BY grp)"
)


def penalties(e):
    return Q.contradictions(e).groupBy("grp").agg(F.count("*").alias("n"), even(-F.least(F.lit(0.2), 0.07 * F.count("*")), 3).alias("penalty"))


query("contradictions", f"WITH {ev_sql()}, {CONTRA} SELECT * FROM c")(lambda t: Q.contradictions(evidence(t)))
query("contradiction_penalty", f"WITH {ev_sql()}, {CONTRA} SELECT grp, n, penalty FROM cp")(lambda t: penalties(evidence(t)))

OVER = f"""w4 AS (SELECT grp, source_id AS s, {t4('text')} AS w FROM ev), k4 AS (SELECT grp, s, len(w) AS n, unnest(w) AS t FROM w4),
    o4 AS (SELECT x.grp, x.s AS a, y.s AS b, round(count(*)::DOUBLE / (x.n + y.n - count(*)), 6) AS jaccard FROM k4 x JOIN k4 y ON x.grp = y.grp AND x.t = y.t AND x.s < y.s GROUP BY x.grp, x.s, y.s, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.75),
    d4 AS (SELECT grp, count(DISTINCT s) AS d FROM (SELECT grp, a AS s FROM o4 UNION ALL SELECT grp, b FROM o4) GROUP BY grp),
    ind AS (SELECT n.grp, round_even(1 - coalesce(d, 0)::DOUBLE / n, 3) AS independence, round_even(-least(0.15::DOUBLE, 0.15::DOUBLE * coalesce(d, 0) / n), 3) AS penalty FROM n LEFT JOIN d4 ON n.grp = d4.grp)"""


def independent(e):
    d = Q.token_overlap(e).select("grp", F.explode(F.array("a", "b")).alias("s")).groupBy("grp").agg(F.countDistinct("s").alias("d"))
    n = e.groupBy("grp").agg(F.count("*").alias("n")).join(d, "grp", "left")
    share = F.coalesce("d", F.lit(0)) / F.col("n")
    return n.select("grp", even(1 - share, 3).alias("independence"), even(-F.least(F.lit(0.15), 0.15 * share), 3).alias("penalty"))


query("token_overlap_join", f"WITH {ev_sql()}, {OVER} SELECT * FROM o4")(lambda t: Q.token_overlap(evidence(t)))
query("source_independence", f"WITH {ev_sql()}, {OVER} SELECT grp, independence, penalty FROM ind")(lambda t: independent(evidence(t)))

# All terms of one group, and what is made of them

TIER_SQL = f"""tc AS (SELECT source_id, text, url,
        {" + ".join(f"least(3, len(regexp_extract_all(lower(text), '(?i){p}')))" for ps in Q.SIGNALS.values() for p in ps)} AS hits,
        {" + ".join(f"CASE WHEN regexp_matches(lower(text), '(?i){p}') THEN 1 ELSE 0 END" for p in Q.BOILERPLATE)} AS boiler,
        len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS s FROM src),
    tv AS (SELECT *, round_even(least(1.0::DOUBLE, least(0.5::DOUBLE, hits * 0.06::DOUBLE) + least(1.0::DOUBLE, words::DOUBLE / 800) * 0.25::DOUBLE + (CASE WHEN words::DOUBLE / s > 3 THEN least(1.0::DOUBLE, words::DOUBLE / s / 15) ELSE 0.2::DOUBLE END) * 0.15::DOUBLE
        + CASE WHEN regexp_matches(url, '{"|".join(Q.URL_TIER1)}') THEN 0.12::DOUBLE WHEN regexp_matches(url, '{"|".join(Q.URL_TIER2)}') THEN 0.06::DOUBLE ELSE 0 END), 3) AS raw FROM tc),
    tf AS (SELECT *, CASE WHEN boiler >= 2 AND length(text) < 500 THEN 0.05::DOUBLE ELSE raw END AS content_score FROM tv),
    tier AS (SELECT source_id, CASE WHEN boiler >= 2 AND length(text) < 500 THEN 3 WHEN content_score >= 0.55 THEN 1 WHEN content_score >= 0.25 THEN 2 ELSE 3 END AS tier, content_score, hits AS signals, words, boiler AS boilerplate_hits FROM tf)"""
AUTH_SQL = f"""ah AS (SELECT source_id, text, replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), 'www.', '') AS host FROM src),
    au AS (SELECT source_id, CASE WHEN host = '{OWN}' THEN 'first' WHEN regexp_matches(host, '(^|\\.)({"|".join(d.replace(".", "[.]") for d in (*Q.ANALYSTS, *Q.NEWS, *Q.REGULATORS))})$')
        OR {" OR ".join(f"regexp_matches(text, '(?i){p}')" for _, _, ps in Q.AUTHORITY_CONTENT for p in ps)} THEN 'third' ELSE 'unknown' END AS side FROM ah)"""
TERMS = f"""{CLAIM_SQL}, {CONTRA}, {OVER}, {TIER_SQL}, {AUTH_SQL},
    ab AS (SELECT grp, CASE WHEN bool_or(side = 'first') AND bool_or(side = 'third') THEN 0.15 WHEN bool_or(side = 'third') THEN 0.105 WHEN bool_or(side = 'first') THEN 0.03 ELSE 0 END::DOUBLE AS boost FROM ev JOIN au USING (source_id) GROUP BY grp),
    tb AS (SELECT grp, greatest(0::DOUBLE, round_even(0.15::DOUBLE - (avg(tier) - 1) * 0.15::DOUBLE / 2, 3)) AS boost FROM ev JOIN tier USING (source_id) GROUP BY grp),
    terms AS MATERIALIZED (SELECT n.grp, n.n AS sources, tb.boost AS tier, corr.score AS corroboration, ind.penalty AS independence, round_even(-0.15::DOUBLE * (0.4::DOUBLE - 0.3::DOUBLE) / 0.4::DOUBLE, 3) AS freshness,
        ab.boost AS authority, coalesce(cp.penalty, 0) AS contradiction FROM n JOIN tb ON tb.grp = n.grp JOIN corr ON corr.grp = n.grp JOIN ind ON ind.grp = n.grp JOIN ab ON ab.grp = n.grp LEFT JOIN cp ON cp.grp = n.grp)"""


def terms(e, as_of: str = "2025-01-01", contradictions=None):
    """(grp, sources, tier, corroboration, independence, freshness, authority, contradiction): every adjustment of a group.

    The documents carry no retrieval time, so a text without a date counts as undated.  contradictions: a
    function of the evidence that gives (grp, n, penalty), in place of the patterns (say, by a model).
    """
    seen = e.select("source_id", "text", "url").distinct()
    newest = F.array_max(Q.extract_dates(F.col("text"))).cast("timestamp")
    kind = Q.authority(F.col("url"), F.col("text"), OWN)["kind"]
    own = seen.select(
        "source_id", Q.tier_classify(F.col("url"), F.col("text"))["tier"].alias("t"), Q.freshness(newest, F.lit(as_of).cast("timestamp")).alias("f"), kind.alias("k")
    )
    first, third = F.bool_or(F.col("k") == "first_party"), F.bool_or(F.col("k").like("third%") | F.col("k").like("reg%"))
    one = e.select("grp", "source_id").join(own, "source_id").groupBy("grp").agg(
        F.count("*").alias("sources"), S.tier_quality(F.avg("t")).alias("tier"), Q.freshness_boost(F.round(F.avg("f"), 9)).alias("freshness"),
        Q.authority_boost(first, third).alias("authority"),
    )
    c = corroborated(e).select("grp", F.col("score").alias("corroboration"))
    i = independent(e).select("grp", F.col("penalty").alias("independence"))
    p = (contradictions or penalties)(e).select("grp", F.col("penalty").alias("contradiction"))
    return one.join(c, "grp").join(i, "grp").join(p, "grp", "left").withColumn("contradiction", F.coalesce("contradiction", F.lit(0.0)))


query(
    "evidence_quality",
    f"WITH {ev_sql()}, {TERMS} SELECT grp, round_even(corroboration * 0.15::DOUBLE + freshness + authority + contradiction, 3) AS adjustment FROM terms",
)(lambda t: terms(evidence(t)).select("grp", even(F.col("corroboration") * 0.15 + F.col("freshness") + F.col("authority") + F.col("contradiction"), 3).alias("adjustment")))



@query(
    "source_eval_rollup",
    f"WITH {ev_sql()}, {TERMS} SELECT round(avg(corroboration), 5) AS corroboration, round(avg(freshness), 5) AS freshness, round(avg(authority), 5) AS authority, CAST(coalesce((SELECT sum(n) FROM cp), 0) AS BIGINT) AS contradictions FROM terms",
)
def _(t):
    e = evidence(t)
    mean = lambda c: F.round(F.avg(c), 5).alias(c)
    one = terms(e).agg(mean("corroboration"), mean("freshness"), mean("authority"))
    return one.crossJoin(Q.contradictions(e).agg(F.count("*").alias("contradictions")))  # one row each


SCORE_SQL = f"""blob AS (SELECT grp, lower(string_agg(text, ' ' ORDER BY rank)) AS blob, count(DISTINCT source_id) AS u FROM ev GROUP BY grp),
    ideal AS (SELECT item_id AS grp, {t56('text', 3)} AS ideal FROM benchmark),
    ovl AS (SELECT blob.grp, u, len(list_intersect(ideal, {t56('blob', 3)}))::DOUBLE / greatest(1, len(ideal)) AS ov FROM blob JOIN ideal USING (grp)),
    sc AS (SELECT grp, u, CASE WHEN ov >= 0.35 THEN 5 WHEN ov >= 0.22 THEN 4 WHEN ov >= 0.12 THEN 3 WHEN ov >= 0.05 THEN 2 ELSE 1 END AS score, round_even(0.35::DOUBLE + least(0.25::DOUBLE, ov), 2) AS base FROM ovl),
    fin AS (SELECT sc.grp, sc.score, base, u, sources, tier, corroboration, independence, freshness, authority, contradiction, round_even(greatest(0, least(1, base + tier + greatest(0, corroboration * 0.15::DOUBLE + independence) + freshness + authority + contradiction + CASE WHEN u >= 3 THEN 0.05::DOUBLE ELSE 0 END
        - CASE WHEN base > 0.3 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN sources < 3 THEN 0.2::DOUBLE ELSE 0 END)), 2) AS confidence FROM sc JOIN terms ON terms.grp = sc.grp)"""


def scored(t, scorer=None, reranker=None, contradictions=None):
    """(grp, score, base, confidence and the terms) of each question: retrieve ten, re-rank to three, score, adjust.

    scorer: a function of (grp, ideal, blob) rows that adds score, base and cited (say, by a model in a pandas
    UDF); where it gives no score, and without one, the overlap with the ideal decides and nothing is cited.
    A question without evidence scores 1 with confidence 0.2.
    """
    ten = evidence(t)
    best = R.rerank(ten.select(F.col("grp").alias("q"), F.col("source_id").alias("id"), "score", "rank", "text"), 3, reranker)
    best = best.select(F.col("q").alias("grp"), F.col("id").alias("source_id"), F.col("rank").alias("place"))
    e = ten.join(best, ["grp", "source_id"]).withColumn("rank", F.col("place")).drop("place")
    blob = F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " "))
    rows = e.groupBy("grp").agg(blob.alias("blob"))
    rubric = F.array(F.lit("1: none"), F.concat(F.lit("5: "), F.col("text")))
    asked = t("benchmark").select(F.col("item_id").alias("grp"), S.score5_text(rubric).alias("ideal"))
    rows = asked.join(rows, "grp", "left")
    none = F.lit(None)
    rows = scorer(rows) if scorer else rows.select("*", none.cast("int").alias("score"), none.cast("double").alias("base"), none.cast("boolean").alias("cited"))
    own, sure = S.rubric_fallback(F.col("ideal"), F.col("blob"))
    rows = rows.select("grp", F.coalesce("score", own).alias("score"), F.when(F.col("score").isNull(), sure).otherwise(F.coalesce("base", F.lit(0.5))).alias("base"), F.coalesce("cited", F.lit(False)).alias("cited"))
    c = F.col
    out = S.enhanced_confidence(c("base"), c("tier"), c("corroboration"), c("independence"), c("freshness"), c("authority"), c("contradiction"), c("sources"), c("cited"), c("sources"))
    got = rows.join(terms(e, contradictions=contradictions), "grp", "left")
    lone = c("sources").isNull()
    return got.withColumn("confidence", F.when(lone, 0.2).otherwise(out)).withColumn("score", F.when(lone, 1).otherwise(c("score")))


_FIN = f"WITH {ev_sql(3)}, {TERMS}, {SCORE_SQL}"
query("rubric_kpi", f"{_FIN} SELECT grp, score, confidence FROM fin")(lambda t: scored(t).select("grp", "score", "confidence"))
query("enhanced_confidence", f"{_FIN} SELECT grp, base, tier, corroboration, independence, freshness, authority, contradiction, confidence FROM fin")(
    lambda t: scored(t).select("grp", "base", "tier", "corroboration", "independence", "freshness", "authority", "contradiction", "confidence")
)
query("impact_table", f"{_FIN} SELECT grp, round(corroboration * 0.15::DOUBLE, 6) AS corroboration, freshness, authority, contradiction, confidence FROM fin")(
    lambda t: scored(t).select("grp", F.round(F.col("corroboration") * 0.15, 6).alias("corroboration"), "freshness", "authority", "contradiction", "confidence")
)
query("confidence_reconstruct", f"{_FIN} SELECT grp, round_even(confidence - tier - corroboration * 0.15::DOUBLE - CASE WHEN u >= 3 THEN 0.05::DOUBLE ELSE 0 END, 4) AS base FROM fin")(
    lambda t: scored(t).select("grp", even(F.col("confidence") - F.col("tier") - F.col("corroboration") * 0.15 - F.when(F.col("sources") >= 3, 0.05).otherwise(0.0), 4).alias("base"))
)


_Q = lambda text: "'" + text.replace("'", "''") + "'"
PROMPT_SQL = f"""blk AS (SELECT grp, string_agg('- [' || source_id || '] ' || url || ': ' || substr(text, 1, 1000), chr(10) ORDER BY rank) AS block FROM ev GROUP BY grp),
    prompts AS (SELECT item_id AS grp, concat({_Q(S.ASK)}, 'KPI: item ', item_id, chr(10), 'Question: ', text, chr(10), 'Rubric:', chr(10), '1: none', chr(10), '5: ', text, chr(10),
        {_Q(S.IDEAL[0])}, trim(text), {_Q(S.IDEAL[1])}, 'Evidence:', chr(10), block, chr(10)) AS prompt FROM benchmark JOIN blk ON blk.grp = item_id)"""


def prompts(t):
    """(grp, prompt) over each question's three best documents."""
    line = F.concat(F.lit("- ["), F.col("source_id").cast("string"), F.lit("] "), "url", F.lit(": "), F.substring("text", 1, 1000))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("l"))))
    block = evidence(t, 3).groupBy("grp").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("block"))
    b = t("benchmark").join(block, F.col("item_id") == F.col("grp"))
    rubric = F.array(F.lit("1: none"), F.concat(F.lit("5: "), "text"))
    return b.select("grp", S.rubric_prompt(F.concat(F.lit("item "), F.col("item_id").cast("string")), F.col("text"), rubric, F.col("block")).alias("prompt"))


query("prompt_build", f"WITH {ev_sql(3)}, {PROMPT_SQL} SELECT grp, prompt FROM prompts")(prompts)
query("prompt_hash", f"WITH {ev_sql(3)}, {PROMPT_SQL} SELECT grp, sha256({_Q(S.SYSTEM)} || chr(0) || prompt) AS h FROM prompts")(
    lambda t: prompts(t).select("grp", S.prompt_hash(F.lit(S.SYSTEM), F.col("prompt")).alias("h"))
)

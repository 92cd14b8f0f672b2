"""Source quality: tiers, claims, corroboration, dates and freshness, authority, contradictions, independence."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions.numbers import even
from veritide.functions import text as T
from veritide.operators.retrieval import small
from veritide.sources.tables import shared_folder

#: Signals of substantive content by category.
SIGNALS = {
    "metrics": (
        r"\d+\.?\d*\s*%",
        r"\$\s*\d+",
        r"\d+\s*(million|billion|mn|bn)",
        r"revenue|EBITDA|margin|ROI|ARR|MRR",
        r"year-over-year|YoY|quarter",
    ),
    "structure": (
        r"(executive\s+summary|table\s+of\s+contents|key\s+(findings|takeaways))",
        r"(methodology|framework|appendix|glossary)",
        r"(figure\s+\d|table\s+\d|chart\s+\d|exhibit\s+\d)",
    ),
    "specificity": (
        r"(case\s+study|deployment|implementation|pilot|POC|proof\s+of\s+concept)",
        r"(benchmark|accuracy|precision|recall|F1|latency\s+\d)",
        r"(patent|peer.reviewed|published\s+in|IEEE|arxiv|ACM)",
    ),
    "governance": (
        r"(board\s+of\s+directors|committee|oversight|audit)",
        r"(policy|regulation|compliance|GDPR|ISO\s+\d)",
        r"(risk\s+assessment|impact\s+assessment|due\s+diligence)",
    ),
}
#: Signals of boilerplate.
BOILERPLATE = (
    r"(cookie\s+(policy|notice|consent)|privacy\s+policy|terms\s+(of\s+use|and\s+conditions))",
    r"(subscribe|newsletter|sign\s+up|follow\s+us|share\s+this)",
    r"(404|page\s+not\s+found|error|coming\s+soon)",
    r"(skip\s+to\s+(main\s+)?content|navigation|breadcrumb)",
)
#: Hints in URLs.
URL_TIER1 = ("investor", "annual", "report", "press", "product", "pricing")
URL_TIER2 = ("blog", "news", "about", "careers", "sustainability")
#: Words of claims, and phrases that no claim has.
CLAIM_WORDS = (
    "ai", "artificial intelligence", "machine learning", "deep learning",
    "generative ai", "genai", "neural network", "nlp", "computer vision",
    "automation", "chatbot", "predictive", "algorithm",
    "deploy", "implement", "launch", "integrate", "develop", "build",
    "partner", "collaborate", "invest", "acquire", "adopt",
    "revenue", "growth", "increase", "decrease", "improve", "reduce",
    "customer", "employee", "team", "engineer",
    "strategy", "framework", "governance", "compliance", "policy",
    "roadmap", "vision", "initiative", "program",
)
NO_CLAIM = (
    "cookie", "privacy policy", "terms of use", "skip to",
    "subscribe", "newsletter", "copyright", "all rights reserved",
    "click here", "read more", "learn more", "sign up",
)
#: Domains of known authority.
ANALYSTS = (
    "gartner.com", "forrester.com", "mckinsey.com", "bcg.com", "bain.com",
    "deloitte.com", "accenture.com", "kpmg.com", "pwc.com", "ey.com",
    "idc.com", "statista.com", "cbinsights.com", "crunchbase.com",
)
NEWS = (
    "reuters.com", "bloomberg.com", "cnbc.com", "ft.com", "bbc.com",
    "techcrunch.com", "theverge.com", "wired.com", "arstechnica.com",
    "zdnet.com", "venturebeat.com", "theregister.com", "businessinsider.com",
    "forbes.com", "fortune.com", "wsj.com", "nytimes.com", "theguardian.com",
)
REGULATORS = ("europa.eu", "gov.uk", "sec.gov", "ftc.gov", "nist.gov", "ico.org.uk", "ofcom.org.uk")
#: Content signals of authority, in their order of precedence.
AUTHORITY_CONTENT = (
    ("third_party_analyst", 0.7, (
        r"(gartner|forrester|mckinsey|bcg|deloitte|accenture|idc)\s",
        r"(magic\s+quadrant|wave\s+report|market\s+guide|hype\s+cycle)",
        r"(analyst|research\s+firm|industry\s+report|market\s+research)",
    )),
    ("third_party_news", 0.65, (
        r"(according\s+to\s+(sources|reports|analysts))",
        r"(reported\s+by|press\s+release|newsroom)",
        r"(exclusive|breaking|reported\s+that)",
    )),
    ("regulatory", 0.75, (
        r"(regulation|directive|act\s+20\d{2}|compliance\s+requirement)",
        r"(European\s+Commission|Parliament|Congress|Federal\s+Trade)",
    )),
)
#: Pairs of patterns that contradict each other: scale, growth, maturity, capability, commitment.
CONTRADICTIONS = (
    (
        r"(large|extensive|significant|major|massive)\s+(team|workforce|department|investment|budget)",
        r"(small|limited|minimal|nascent|emerging)\s+(team|workforce|department|investment|budget)",
    ),
    (
        r"(growing|increasing|expanding|accelerating)\s+(revenue|adoption|usage|deployment)",
        r"(declining|decreasing|shrinking|slowing)\s+(revenue|adoption|usage|deployment)",
    ),
    (
        r"(mature|established|proven|production.grade|enterprise.ready)",
        r"(early.stage|experimental|pilot|prototype|proof.of.concept|nascent)",
    ),
    (
        r"(leading|best.in.class|state.of.the.art|advanced|sophisticated)",
        r"(lagging|behind|catching\s+up|basic|rudimentary)",
    ),
    (
        r"(committed|dedicated|priorit|strategic\s+focus|core\s+to)",
        r"(exploring|considering|evaluating|no\s+plans|deprioritiz)",
    ),
)
#: Month names and their abbreviations.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def lowered(pattern: str) -> str:
    """A pattern for lower-cased text: its letters in lower case, its escapes as they are."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


def tier_classify(url: Column, text: Column, title: Column | None = None, signals=None, boilerplate=BOILERPLATE) -> Column:
    """struct<tier, content_score, signals, words, boilerplate_hits> of one source; patterns are parameters."""
    signals = [p for ps in SIGNALS.values() for p in ps] if signals is None else signals
    one = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  # f of a value that is computed once

    def counted(both: Column) -> Column:
        hits, boiler = F.lit(0), F.lit(0)
        for p in signals:
            hits = hits + F.least(F.lit(3), F.regexp_count(both, F.lit(lowered(p))))
        for p in boilerplate:
            boiler = boiler + F.when(both.rlike(lowered(p)), 1).otherwise(0)
        words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        return F.struct(hits.alias("hits"), boiler.alias("boiler"), words.alias("words"), F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1)).alias("ends"))

    any_of = lambda hints: F.lower(url).rlike("|".join(hints))

    def judged(c: Column) -> Column:
        per = c["words"] / c["ends"]
        shape = F.when(per > 3, F.least(F.lit(1.0), per / 15)).otherwise(0.2)
        bonus = F.when(any_of(URL_TIER1), 0.12).when(any_of(URL_TIER2), 0.06).otherwise(0.0)
        score = F.least(F.lit(0.5), c["hits"] * 0.06) + F.least(F.lit(1.0), c["words"] / 800) * 0.25 + shape * 0.15 + bonus
        score = even(F.least(F.lit(1.0), score), 3)
        thin = (c["boiler"] >= 2) & (F.char_length(text) < 500)
        score = F.when(thin, 0.05).otherwise(score)
        tier = F.when(thin, 3).when(score >= 0.55, 1).when(score >= 0.25, 2).otherwise(3)
        return F.struct(tier.alias("tier"), score.alias("content_score"), c["hits"].alias("signals"), c["words"].alias("words"), c["boiler"].alias("boilerplate_hits"))

    return one(one(F.lower(text) if title is None else F.lower(F.concat_ws(" ", title, text)), counted), judged)


def extract_claims(sources: DataFrame, id_col: str, text_col: str, keywords=CLAIM_WORDS, banned=NO_CLAIM, most: int = 30) -> DataFrame:
    """(source_id, pos, claim): sentences of 30 to 500 characters with a keyword; the first of equal beginnings, at most ``most``.

    All of it happens inside a source's row, so nothing is shuffled.
    """
    has = lambda low, words: reduce(or_, [low.contains(w) for w in words])

    def fit(c: Column) -> Column:
        low = F.lower(c)
        return F.char_length(c).between(30, 500) & ~has(low, banned) & has(low, keywords)

    numbered = F.transform(T.sentences(F.col(text_col)), lambda s, i: F.struct(i.alias("pos"), F.trim(F.regexp_replace(s, r"\s+", " ")).alias("claim")))
    rows = sources.select(F.col(id_col).alias("source_id"), F.filter(numbered, lambda x: fit(x["claim"])).alias("c"))
    rows = rows.select("source_id", "c", F.transform("c", lambda x: F.substring(F.lower(x["claim"]), 1, 60)).alias("k"))
    first = F.filter("c", lambda x, i: F.array_position("k", F.get("k", i)) == i + 1)
    return rows.select("source_id", F.explode(F.slice(first, 1, most)).alias("c")).select("source_id", "c.pos", "c.claim")


def claim_pairs(claims: DataFrame, least: float = 0.35) -> DataFrame:
    """(a, b, pa, pb, sim) of claims of two sources of one group (column ``grp``) with multiset Jaccard and number bonus >= least.

    Only claims that share a word can reach the threshold, so words join them; very common words do not
    widen it beyond a group.
    """
    tok = claims.select("grp", "source_id", "pos", "claim", F.explode(T.metric_words(F.col("claim"), T.STOP_CLAIMS)).alias("w"))
    cnt = tok.groupBy("grp", "source_id", "pos", "w").agg(F.count("*").alias("c"))
    size = cnt.groupBy("grp", "source_id", "pos").agg(F.sum("c").alias("n"))
    cnt = cnt.join(size, ["grp", "source_id", "pos"])
    x = cnt.select("grp", "w", F.col("source_id").alias("a"), F.col("pos").alias("pa"), F.col("c").alias("ca"), F.col("n").alias("na"))
    y = cnt.select("grp", "w", F.col("source_id").alias("b"), F.col("pos").alias("pb"), F.col("c").alias("cb"), F.col("n").alias("nb"))
    both = x.join(y, ["grp", "w"]).where("a < b").groupBy("grp", "a", "pa", "b", "pb", "na", "nb").agg(F.sum(F.least("ca", "cb")).alias("s"))
    num = claims.select("grp", "source_id", "pos", F.array_distinct(F.regexp_extract_all("claim", F.lit(r"\d+\.?\d*"), F.lit(0))).alias("nums"))
    both = both.join(num.select("grp", F.col("source_id").alias("a"), F.col("pos").alias("pa"), F.col("nums").alias("x")), ["grp", "a", "pa"])
    both = both.join(num.select("grp", F.col("source_id").alias("b"), F.col("pos").alias("pb"), F.col("nums").alias("y")), ["grp", "b", "pb"])
    bonus = F.least(F.lit(0.15), 0.05 * F.size(F.array_intersect("x", "y")))
    sim = F.least(F.lit(1.0), F.col("s") / (F.col("na") + F.col("nb") - F.col("s")) + bonus)
    return both.withColumn("sim", F.round(sim, 6)).where(F.col("sim") >= least).select("grp", "a", "b", "pa", "pb", "sim")


def corroboration(n_sources: Column, n_pairs: Column, n_in_pairs: Column) -> Column:
    """Score of a group from its sources, similar pairs and sources in pairs."""
    some = F.least(F.lit(0.5), 0.08 * n_pairs) + F.least(F.lit(0.5), 0.12 * n_in_pairs)
    return F.when(n_sources < 2, 0.0).when(n_pairs == 0, even(F.least(F.lit(0.3), 0.1 * n_sources), 2)).otherwise(even(some, 2))


def _month(name: Column) -> Column:
    low = F.lower(name)
    pairs = [x for i, m in enumerate(MONTHS, 1) for x in ((m, i), (m[:3], i))]
    table = F.create_map(*[F.lit(v) for p in dict(pairs).items() for v in p])
    return F.try_element_at(table, low)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def extract_dates(text: Column, month_day: int = 15, with_day: bool = True) -> Column:
    """All dates in a text, with repeats: ISO or slashed, ``D Month YYYY`` and ``Month YYYY`` (on ``month_day``); invalid ones are dropped."""
    g = lambda s, p, i: F.regexp_extract(s, p, i)
    iso, day, mon = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b", r"\b(\d{1,2})\s+([A-Za-z]{3,9})\s+(20\d{2})\b", r"\b([A-Za-z]{3,9})\s+(20\d{2})\b"
    found = [F.transform(F.regexp_extract_all(text, F.lit(iso), F.lit(0)), lambda s: _date(g(s, iso, 1), g(s, iso, 2), g(s, iso, 3)))]
    if with_day:
        found.append(F.transform(F.regexp_extract_all(text, F.lit(day), F.lit(0)), lambda s: _date(g(s, day, 3), _month(g(s, day, 2)), g(s, day, 1))))
    found.append(F.transform(F.regexp_extract_all(text, F.lit(mon), F.lit(0)), lambda s: _date(g(s, mon, 2), _month(g(s, mon, 1)), F.lit(str(month_day)))))
    return F.array_compact(F.concat(*found))


def freshness(newest: Column, as_of: Column) -> Column:
    """1 for today down to 0.1 for two years and more; 0.3 without a date.  Days are floors of seconds."""
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(newest)) / 86400))
    return F.when(newest.isNull(), 0.3).otherwise(F.greatest(F.lit(0.1), even(1 - F.pow(F.least(F.lit(1.0), age / 730.0), F.lit(0.7)), 3)))


def freshness_boost(avg: Column) -> Column:
    return even(F.when(avg >= 0.7, 0.10 * (avg - 0.7) / 0.3).when(avg < 0.4, -0.15 * (0.4 - avg) / 0.4).otherwise(0.0), 3)


def authority(url: Column, text: Column, own: str = "") -> Column:
    """struct<kind, score, third> of one source: own domain, known domains, then content signals."""
    name = F.replace(F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    base = own.lower().replace("www.", "")
    of = lambda kind, score, third: F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"), F.lit(third).alias("third"))
    inside = lambda ds: name.rlike("(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in ds) + ")$")
    out = F.when((name == base) | name.endswith("." + base) if base else F.lit(False), of("first_party", 0.5, False))
    for ds, kind, score in ((ANALYSTS, "third_party_analyst", 0.9), (NEWS, "third_party_news", 0.8), (REGULATORS, "regulatory", 0.95)):
        out = out.when(inside(ds), of(kind, score, True))
    for kind, score, patterns in AUTHORITY_CONTENT:
        out = out.when(F.lower(text).rlike("|".join(lowered(p) for p in patterns)), of(kind, score, True))
    return out.otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit(0.4).alias("score"), (name != base).alias("third")))


def authority_boost(first: Column, third: Column) -> Column:
    return F.when(first & third, 0.15).when(third, 0.105).when(first, 0.03).otherwise(0.0)


def contradictions(sources: DataFrame, pairs=CONTRADICTIONS) -> DataFrame:
    """(grp, a, b, claim_a, claim_b) where source a of a group matches the first and b the second pattern of a pair."""
    low = F.lower("text")
    rows = []
    for i, (pos, neg) in enumerate(pairs):
        for side, p in (("pos", pos), ("neg", neg)):
            hit = F.regexp_extract(low, lowered(p), 0)
            rows.append(F.struct(F.lit(i).alias("p"), F.lit(side).alias("side"), F.substring(hit, 1, 150).alias("claim")))
    m = sources.select("grp", "source_id", F.explode(F.array(*rows)).alias("m")).where("m.claim <> ''").select("grp", "source_id", "m.*")
    x = m.where("side = 'pos'").select("grp", "p", F.col("source_id").alias("a"), F.col("claim").alias("claim_a"))
    y = m.where("side = 'neg'").select("grp", "p", F.col("source_id").alias("b"), F.col("claim").alias("claim_b"))
    both = x.join(y, ["grp", "p"]).where("a <> b").withColumn("k", F.substring("claim_a", 1, 50))
    return both.groupBy("grp", "a", "b", "k").agg(F.min(F.struct("p", "claim_a", "claim_b")).alias("c")).select("grp", "a", "b", "c.claim_a", "c.claim_b")


def token_overlap(sources: DataFrame, least: float = 0.75) -> DataFrame:
    """(grp, a, b, jaccard) of sources of one group whose T4 words overlap to ``least``; words join them, no pairs are listed blindly."""
    w = sources.select("grp", "source_id", T.source_words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    tok = w.select("grp", "source_id", "n", F.explode("w").alias("t"))
    x = tok.select("grp", "t", F.col("source_id").alias("a"), F.col("n").alias("na"))
    y = tok.select("grp", "t", F.col("source_id").alias("b"), F.col("n").alias("nb"))
    alike = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    both = x.join(y, ["grp", "t"]).where((F.col("a") < F.col("b")) & alike).groupBy("grp", "a", "b", "na", "nb").agg(F.count("*").alias("s"))
    j = F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))
    return both.where(j >= least).select("grp", "a", "b", F.round(j, 6).alias("jaccard"))


def token_links(sources: DataFrame, least: float = 0.75, common: int = 1_000_000) -> DataFrame:
    """(source_id, class_id, copies, links) of every row: how many other rows' T4 words overlap its own to ``least``.

    All rows are compared.  Rows of equal words are one class (class_id is its smallest id); classes are
    joined on the rarest words of each, as many as two that reach ``least`` must have one of in common, and
    full sets decide.  Rows without such words link with nothing and form their own class.

    Words are 64-bit hashes in a table of the shared folder, so each text is read once.  Their order by
    number of classes is known for the ``common`` most frequent ones at most; the others come before these,
    by hash: any order is right.  A word's classes meet by size and place (see ``_meeting``); marks of 128
    bytes, which bound the difference of two sets, rule most of these pairs out.  What is left compares half
    hashes, and whole ones where two of those that clash by chance would decide.
    """
    spark = sources.sparkSession
    place = f"{shared_folder(spark)}/veritide-links/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.schema(df.schema).parquet(f"{place}/{name}")

    w = sources.select("source_id", F.coalesce(F.array_sort(T.source_words(F.col("text"))), F.array().cast("array<string>")).alias("w"))
    key = F.when(F.size("w") > 0, F.unhex(F.sha2(F.array_join("w", " "), 256)))
    rows = kept(w.select(F.monotonically_increasing_id().alias("i"), "source_id", key.alias("key"), F.transform("w", lambda t: F.xxhash64(t)).alias("h")), "rows")
    worded = rows.where("key IS NOT NULL")
    classes = kept(worded.groupBy("key").agg(F.min("i").alias("i"), F.min("source_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    again = worded.select("i", "key").join(classes.select("key", F.col("i").alias("first")), "key").where("i <> first").select("i")
    sets = worded.select("i", "h").join(small(again), "i", "left_anti")

    df = kept(sets.select(F.explode("h").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "words")
    sizes = sorted(df.groupBy("c").count().collect(), reverse=True)
    from_c, n = 2, 0
    for c, words in sizes:
        n += words
        if n > common:
            from_c = c + 1
            break
    known = df.where(F.col("c") >= from_c).orderBy("t").toArrow()
    heads = sets.mapInArrow(_heads(known.column("t").to_numpy(), known.column("c").to_numpy(), least, from_c == 2), "t long, i long, n int, p int")
    pairs = heads.repartition("t").sortWithinPartitions("t", "n").mapInArrow(_meeting(least), "a long, b long")
    pairs = kept(pairs.distinct(), "pairs")

    of = lambda df, pairs: df.join(small(pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct()), "i", "left_semi")
    side = lambda df, k, *c: df.select(F.col("i").alias(k), *(F.col(x).alias(f"{x}{k}") for x in c))
    marks = of(sets, pairs).mapInArrow(_marks, "i long, n int, m binary")
    near = pairs.join(side(marks, "a", "n", "m"), "a").join(side(marks, "b", "n", "m"), "b").select("a", "b", "na", "nb", "ma", "mb")
    near = kept(near.mapInArrow(_close(least), "a long, b long, na int, nb int"), "near")

    def shared(pairs: DataFrame, halved: bool) -> DataFrame:
        some = of(sets, pairs).select("i", F.transform("h", lambda x: (x % 2**31).cast("int")).alias("h") if halved else "h")
        met = pairs.join(side(some, "a", "h"), "a").join(side(some, "b", "h"), "b")
        return met.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("s"))

    alike = lambda d: (F.col("s") + d) / (F.col("na") + F.col("nb") - F.col("s") - d) >= least
    half = kept(shared(near, True).where(alike(2)).withColumn("sure", alike(-2)), "half")
    both = half.where("sure").select("a", "b").unionByName(shared(half.where("NOT sure").drop("s", "sure"), False).where(alike(0)).select("a", "b"))
    copies = lambda k: classes.select(F.col("i").alias(k), F.col("copies").alias(f"c{k}"))
    both = both.join(copies("a"), "a").join(copies("b"), "b")
    more = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("cb").alias("c")), F.struct(F.col("b").alias("i"), F.col("ca").alias("c"))))
    more = both.select(more.alias("m")).groupBy("m.i").agg(F.sum("m.c").alias("more"))
    found = classes.join(more, "i", "left").drop("i")
    one = F.lit(1).cast("long")
    return rows.select("source_id", "key").join(found, "key", "left").select(
        "source_id", F.when(F.col("key").isNull(), F.col("source_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", one).alias("copies"), (F.coalesce("copies", one) - 1 + F.coalesce("more", F.lit(0))).alias("links"),
    )


def _heads(names, counts, least: float, whole: bool, rows: int = 1000):
    """(t, i, n, p) of sets (i, h): the rarest words that two sets of overlap ``least`` must share one of, with the set's size and the word's place.

    names, counts: the known words in their order, and in how many sets they are.  whole: all other words are in one set only, and are left out.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in (x.slice(k, rows) for x in batches for k in range(0, x.num_rows, rows)):
            sizes = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            c = np.zeros(len(flat), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                c = np.where(names[at] == flat, counts[at], 0)
            order = np.lexsort((flat, c, row))
            n = sizes[row]
            p = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]
            head = p < n - np.ceil(n * least - 1e-9) + 1
            if whole:
                head &= c[order] > 0
            cols = flat[order][head], b.column(0).to_numpy()[row][head], n[head].astype(np.int32), p[head].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["t", "i", "n", "p"])

    return run


def _marks(batches, bits: int = 1024, rows: int = 1000):
    """(i, n, m) of sets (i, h): size and the parities of the words' numbers by hash bucket; two marks differ in no more bits than the sets in words."""
    import numpy as np
    import pyarrow as pa

    for b in (x.slice(k, rows) for x in batches for k in range(0, x.num_rows, rows)):
        sizes = np.diff(b.column(1).offsets.to_numpy())
        at = np.repeat(np.arange(len(sizes)), sizes) * bits + (b.column(1).flatten().to_numpy() & (bits - 1))
        odd = np.bincount(at, minlength=len(sizes) * bits).reshape(-1, bits) & 1
        marks = [x.tobytes() for x in np.packbits(odd.astype(np.uint8), axis=1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())], ["i", "n", "m"])


def _close(least: float):
    """Those pairs (a, b, na, nb, ma, mb) whose marks do not show that they miss ``least``."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (4, 5))
                most = (1 - least) / (1 + least) * (b.column(2).to_numpy().astype(float) + b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays(b.columns[:4], ["a", "b", "na", "nb"]).filter(pa.array(np.bitwise_count(x ^ y).sum(1) <= most + 1e-6))

    return run


def _meeting(least: float, most: int = 1_000_000):
    """(a, b), a < b, of the sets of each word that can reach ``least`` by their sizes and by the words behind this one; rows come sorted by word and size.

    At most about ``most`` pairs are held at once, however many sets have a word.
    """
    import numpy as np
    import pyarrow as pa

    def met(t, i, n, p):
        g = np.cumsum(np.r_[0, t[1:] != t[:-1]]) << 32
        places = np.arange(len(t))
        partners = np.searchsorted(g + n, g + np.floor(n / least + 1e-9).astype(np.int64), "right") - places - 1
        total = np.cumsum(partners)
        lo = 0
        while lo < len(t):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
            k = partners[lo:hi]
            x = np.repeat(places[lo:hi], k)
            y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + x + 1
            ok = np.minimum(n[x] - p[x], n[y] - p[y]) >= (n[x] + n[y]) * (least / (1 + least)) - 1e-6
            x, y = i[x[ok]], i[y[ok]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            lo = hi

    def run(batches):
        rest = None
        for b in batches:
            cols = [c.to_numpy().astype(np.int64) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            if cut:
                yield from met(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
        if rest is not None and len(rest[0]):
            yield from met(*rest)

    return run

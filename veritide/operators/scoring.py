"""KPI scoring: rubric and quantitative fallbacks, confidence, gates, attribution and cut-off rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions.numbers import even
from veritide.functions.text import long_words, overlap

#: Recommended k by kind and complexity.
K_TABLE = (
    ("rubric", "low", 6), ("rubric", "medium", 8), ("rubric", "high", 10),
    ("quant", "low", 6), ("quant", "medium", 8), ("quant", "high", 10),
    ("recency", "low", 10), ("recency", "medium", 12), ("recency", "high", 15),
)


def dynamic_k(kind: Column, question: Column, rubric: Column, default: int = 6, counting=("count", "mention", "how many", "number of")) -> Column:
    """k by kind of KPI, length of its rubric and words of its question."""
    asked = F.lit(False)
    for w in counting:
        asked = asked | F.lower(question).contains(w)
    n = F.char_length(rubric)
    return (
        F.when(kind == "rubric", F.when(n > 500, 10).when(n > 200, 8).otherwise(6))
        .when(kind == "quant", F.when(asked, 8).otherwise(6))
        .when(kind == "recency", 12)
        .otherwise(default)
    )


def k_recommendations(kpis: DataFrame) -> DataFrame:
    """``kpis`` (kpi_type, complexity) with recommended_k, min_k and max_k; unknown kinds count as rubric, levels as 8."""
    spark = kpis.sparkSession
    table = spark.createDataFrame(K_TABLE, "_kind string, _level string, _k int")
    known = F.when(F.col("kpi_type").isin("rubric", "quant", "recency"), F.col("kpi_type")).otherwise("rubric")
    out = kpis.withColumn("_want", known).join(F.broadcast(table), (F.col("_want") == F.col("_kind")) & (F.col("complexity") == F.col("_level")), "left")
    return out.select(*kpis.columns, F.coalesce("_k", F.lit(8)).alias("recommended_k"), F.lit(6).alias("min_k"), F.lit(15).alias("max_k"))


def threshold_score(value: Column, thresholds: list[int]) -> Column:
    """1 below the first threshold, one more for each that is reached; padded to four by 3, 5, 8, 12."""
    ts = (list(thresholds) + [3, 5, 8, 12])[:4]
    out = F.lit(5)
    for i in (3, 2, 1, 0):
        out = F.when(value < ts[i], i + 1).otherwise(out)
    return out


def recency_score(days: Column, thresholds: list[int]) -> Column:
    """5 up to the first threshold of days, one less for each that is passed; null days stay null."""
    ts = (list(thresholds) + [3, 5, 8, 12])[:4]
    out = F.lit(1)
    for i in (3, 2, 1, 0):
        out = F.when(days <= ts[i], 5 - i).otherwise(out)
    return F.when(days.isNotNull(), out)


def band_score(overlap: Column, has_both: Column | None = None) -> Column:
    """1 to 5 by the share of ideal words found."""
    out = F.when(overlap >= 0.35, 5).when(overlap >= 0.22, 4).when(overlap >= 0.12, 3).when(overlap >= 0.05, 2).otherwise(1)
    return out if has_both is None else F.when(has_both, out).otherwise(3)


#: Hint words of the scoring without rubric.
POSITIVE = ("strong", "improve", "growth", "quality", "efficient", "optimized")
NEGATIVE = ("risk", "decline", "issue", "problem", "weak")


def hint_score(blob: Column) -> Column:
    """3, one more for each positive and one less for each negative hint word in a lower-cased text, within 1 to 5."""
    has = lambda words: sum((blob.contains(w).cast("int") for w in words), F.lit(0))
    return F.least(F.lit(5), F.greatest(F.lit(1), 3 + has(POSITIVE) - has(NEGATIVE)))


def legacy_score(blob: Column) -> Column:
    """60, five more for each positive and less for each negative hint word, within 0 to 100; the seeded noise is left out."""
    has = lambda words: sum((blob.contains(w).cast("int") for w in words), F.lit(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), 60 + 5 * has(POSITIVE) - 5 * has(NEGATIVE)))


def gates(faithfulness: Column, mean: Column, std: Column, primary: Column, total: Column, foreign: Column) -> Column:
    """struct of the four quality gates of one KPI.

    faithful (at least 0.8, else blocked; null passes as null), stable (deviation at most 0.4, else the score
    shows as a range), covered (at least 0.4 of the chunks primary, none of no chunks, else suppressed), and
    bleed (a chunk of a foreign entity, which blocks).
    """
    faithful, stable = faithfulness >= 0.8, std <= 0.4
    share = F.when(total > 0, primary / total).otherwise(0.0)
    bleed = F.coalesce(foreign, F.lit(False))
    lo, hi = (even(mean + k * std, 2).cast("string") for k in (-1, 1))
    return F.struct(
        (F.coalesce(~faithful, F.lit(False)) | bleed).alias("blocked"), faithful.alias("faithful"), stable.alias("stable"),
        F.when(~stable, F.concat(lo, F.lit("–"), hi)).alias("score_range"), (share < 0.4).alias("suppress"), bleed.alias("bleed"),
    )


def rubric_fallback(ideal: Column, blob: Column) -> tuple[Column, Column]:
    """(score, confidence) without a model: overlap of the lower-cased evidence with the ideal, else hint words."""
    text, want = F.coalesce(blob, F.lit("")), long_words(F.coalesce(ideal, F.lit("")), 3)
    ov = overlap(want, long_words(text, 3))
    known = (text != "") & (F.size(want) > 0)
    sure = F.when(known, even(0.35 + F.least(F.lit(0.25), ov), 2)).otherwise(F.when(text != "", 0.4).otherwise(0.2))
    return F.when(known, band_score(ov)).otherwise(hint_score(text)), sure


def score5_text(rubric: Column) -> Column:
    """Text behind the first rubric line that begins with ``5:``; null if there is none."""
    lines = F.filter(F.transform(rubric, lambda s: F.trim(s)), lambda s: s.startswith("5:"))
    first = F.get(lines, 0)
    return F.trim(F.substr(first, F.lit(3)))


def count_mentions(text: Column, words) -> Column:
    """Non-overlapping mentions of each keyword, summed: overlapping keywords count twice."""
    low = F.lower(text)
    total = F.lit(0)
    for w in words:
        total = total + (F.char_length(low) - F.char_length(F.replace(low, F.lit(w.lower()), F.lit("")))) / len(w)
    return F.coalesce(total, F.lit(0)).cast("long")


def enhanced_confidence(base, tier, corroboration, independence, fresh, authority, contradiction, sources, cited, n_chunks) -> Column:
    """Base confidence and all adjustments, clamped to 0..1 and rounded to two digits."""
    extra = tier + F.greatest(F.lit(0.0), corroboration * 0.15 + independence) + fresh + authority + contradiction
    out = base + extra + F.when(sources >= 3, 0.05).otherwise(0.0)
    out = out - F.when(~cited & (base > 0.3), 0.3).otherwise(0.0) - F.when(n_chunks < 3, 0.2).otherwise(0.0)
    return even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 2)  # the sum's last digits don't decide a tie


def tier_quality(avg_tier: Column, most: float = 0.15) -> Column:
    return F.coalesce(even(F.greatest(F.lit(0.0), most - (avg_tier - 1) * most / 2), 3), F.lit(0.0))


#: Texts of metrics by their lower thresholds, best first.
VERBAL = {
    "ragas_faithfulness": ((0.6, "Answer well grounded in evidence"), (0.2, "Answer poorly grounded in evidence"), (None, "Answer barely grounded in evidence")),
    "ragas_answer_relevancy": ((0.5, "Answer addresses the question"), (0.2, "Answer partly addresses the question"), (None, "Answer does not address the question")),
    "ragas_context_precision": ((0.4, "Retrieved sources are on-topic"), (0.1, "Retrieved sources partly on-topic"), (None, "Retrieved sources mostly off-topic")),
    "ragas_context_recall": ((0.5, "Evidence covers the expected content"), (0.2, "Evidence partly covers expected content"), (None, "Evidence misses expected content")),
    "recall_at_3": ((0.5, "Key info in top results"), (0.1, "Key info not in top results"), (None, "Key info missing from top results")),
    "f1": ((0.4, "Answer matches reference well"), (0.15, "Answer partly matches reference"), (None, "Answer does not match reference")),
    "mmr_diversity_score": ((0.9, "Sources are extremely diverse"), (0.6, "Sources are diverse"), (0.3, "Sources have moderate diversity"), (None, "Sources are repetitive")),
    "factual_correctness": ((0.5, "Claims align with ideal answer"), (0.2, "Claims partly align"), (None, "Claims do not align with ideal")),
    "semantic_similarity": ((0.6, "Meaning matches ideal answer"), (0.4, "Meaning partly matches"), (None, "Meaning diverges from ideal")),
}
#: Texts of metrics where low is good, by their upper thresholds.
VERBAL_LOW = {
    "hallucination_score": ((0.3, "Low risk of unsupported content"), (0.6, "Some unsupported content"), (None, "High risk of unsupported content (flagged)")),
    "noise_sensitivity": ((0.2, "Not misled by low-quality sources"), (0.5, "Slightly affected by noise"), (None, "Noticeably misled by poor sources")),
}


def verbal(metric: str, value: Column) -> Column:
    """One line for a metric's value; null is ``Not available``."""
    if metric == "llm_judge_overall":
        return F.when(value.isNull(), "Not available").otherwise(F.concat(F.lit("AI reviewer rated "), value.cast("int").cast("string"), F.lit("/5")))
    high = metric in VERBAL
    out = F.when(value.isNull(), "Not available")
    for at, text in (VERBAL if high else VERBAL_LOW)[metric]:
        out = out.otherwise(text) if at is None else out.when(value >= at if high else value <= at, text)
    return out


#: The texts of the scoring prompt; its hash identifies a run, so they are kept to the letter.
SYSTEM = "You are a strict JSON generator."
ASK = (
    "You are a Business Analyst. Your task is to audit the following context using \n"
    "the KPI Drivers.\n"
    "Score the KPI from 1-5 using the rubric and evidence.\n"
    'Return strict JSON: {"kpi_id": "...", "score": 1-5, "confidence": 0-1, "rationale": "...", '
    '"citations": [{"source_id": "...", "url": "...", "quote": "..."}]}.\n'
    "Citations must include source_id, url, quote.\n\n"
)
IDEAL = ('\nIdeal (5 = High): "', '"\nScore how close the evidence supports this level (1 = not at all, 5 = fully).\n')


def rubric_prompt(name: Column, question: Column, rubric: Column, evidence: Column) -> Column:
    """The user prompt of a KPI: its question, its rubric's lines, its ideal, and its evidence block."""
    ideal = score5_text(rubric)
    line = F.coalesce(F.concat(F.lit(IDEAL[0]), F.nullif(ideal, F.lit("")), F.lit(IDEAL[1])), F.lit(""))
    return F.concat(
        F.lit(ASK), F.lit("KPI: "), name, F.lit("\nQuestion: "), question, F.lit("\nRubric:\n"), F.array_join(rubric, "\n"), F.lit("\n"),
        line, F.lit("Evidence:\n"), F.coalesce(evidence, F.lit("")), F.lit("\n"),
    )


def prompt_hash(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(system, F.char(F.lit(0)), user), 256)

"""Operators backed by models, which callers pass in; without a model each gives its documented default.

A model is a function of a DataFrame that returns it with columns added, say by a pandas UDF, so that it
runs on the executors in batches.  Rows for which it adds null fall back like rows without a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions.numbers import even
from veritide.functions.text import long_words, overlap
from veritide.operators.scoring import band_score

Model = Callable[[DataFrame], DataFrame]
JUDGED = ("correctness", "completeness", "clarity", "overall")
THOUGHT = ("cot_specificity", "cot_evidence", "cot_alignment")


def with_nulls(df: DataFrame, model: Model | None, columns: dict[str, str]) -> DataFrame:
    """``df`` with the model's columns, or nulls of their types."""
    if model is None:
        return df.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in columns.items()))
    return model(df).select(*df.columns, *(F.col(c).cast(kind).alias(c) for c, kind in columns.items()))


def _one_to_five(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.col(c)))).alias(c)


def judged(rows: DataFrame, judge: Model | None = None) -> DataFrame:
    """``rows`` (question, answer, contexts) with four scores, feedback and llm_used; null scores without a judge's answer.

    judge adds correctness, completeness, clarity, overall and feedback.
    """
    got = with_nulls(rows, judge, {**dict.fromkeys(JUDGED, "int"), "feedback": "string"})
    used = F.coalesce(*(F.col(c) for c in JUDGED)).isNotNull()
    score = lambda c: F.when(used, F.coalesce(c, F.lit(3))).alias(c)
    said = F.when(used, F.coalesce("feedback", F.lit(""))).otherwise("LLM judge unavailable.")
    return got.select(*rows.columns, *map(score, JUDGED), said.alias("feedback"), used.alias("llm_used"))


def chain_of_thought(rows: DataFrame, scorer: Model | None = None, enabled: bool = True) -> DataFrame:
    """``rows`` (rationale, contexts) with three scores of 1 to 5 and weak_reasoning where one is under 3; nulls and false by default.

    Rows without rationale are not scored.
    """
    got = with_nulls(rows, scorer if enabled else None, dict.fromkeys(THOUGHT, "int"))
    there = F.coalesce(F.col("rationale"), F.lit("")) != ""
    got = got.select(*rows.columns, *(F.when(there, _one_to_five(c)).alias(c) for c in THOUGHT))
    return got.withColumn("weak_reasoning", F.coalesce(F.least(*THOUGHT) < 3, F.lit(False)))


def grounded(rows: DataFrame, scorer: Model | None = None, least: float = 0.75, enabled: bool = True) -> DataFrame:
    """``rows`` (rationale, chunks) with bertscore_f1 and low_semantic_grounding (under ``least``); null and false by default.

    scorer reads rationale and reference, the first 800 characters of the first three chunks.
    """
    ref = F.array_join(F.transform(F.slice("chunks", 1, 3), lambda c: F.substring(c, 1, 800)), " ")
    got = with_nulls(rows.withColumn("reference", ref), scorer if enabled else None, {"bertscore_f1": "double"})
    there = (F.coalesce(F.col("rationale"), F.lit("")) != "") & (F.size("chunks") > 0)
    f1 = F.when(there, even("bertscore_f1", 4))
    return got.select(*rows.columns, f1.alias("bertscore_f1")).withColumn("low_semantic_grounding", F.coalesce(F.col("bertscore_f1") < least, F.lit(False)))


def prompt_heuristic(rubric: Column, evidence: Column) -> Column:
    """1.0 to 5.0 by the share of the rubric's words that the evidence has; 3.0 if either has none."""
    want, have = long_words(F.coalesce(rubric, F.lit("")), 4), long_words(F.coalesce(evidence, F.lit("")), 4)
    both = (F.size(want) > 0) & (F.size(have) > 0)
    return F.when(both, band_score(overlap(want, have)).cast("double")).otherwise(3.0)


def repeated_scores(rows: DataFrame, scorer: Model | None = None, runs: int = 5) -> DataFrame:
    """``rows`` (rubric, evidence) with raw_scores, mean, std and successful_runs of ``runs`` scorings.

    scorer adds score from a column run (0, 1, ...), null where a run fails.  Where none succeeds, the
    heuristic stands in for each run, with deviation 0 and no successful runs; one success has deviation 0.
    """
    some = rows
    for r in range(runs):
        got = with_nulls(some.withColumn("run", F.lit(r)), scorer, {"score": "double"})
        some = got.withColumnRenamed("score", f"_s{r}").drop("run")
    raw = F.array_compact(F.array(*(F.col(f"_s{r}") for r in range(runs)))) if runs else F.array().cast("array<double>")
    some = some.select(*rows.columns, raw.alias("_raw"), prompt_heuristic(F.col("rubric"), F.col("evidence")).alias("_h"))
    n, add = F.size("_raw"), lambda a, x: a + x
    mean = F.aggregate("_raw", F.lit(0.0), add) / n
    squares = F.aggregate(F.transform("_raw", lambda x: (x - mean) * (x - mean)), F.lit(0.0), add)
    none = n == 0
    return some.select(
        *rows.columns, F.when(none, F.array_repeat("_h", max(1, runs))).otherwise(F.col("_raw")).alias("raw_scores"),
        even(F.when(none, F.col("_h")).otherwise(mean), 4).alias("mean"),
        even(F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0), 4).alias("std"), n.alias("successful_runs"),
    )


def embedded(rows: DataFrame, text_col: str = "text", embedder: Model | None = None, dims: int = 256) -> DataFrame:
    """``rows`` with embedding array<double>: by the embedder, else the dense hash embedding of norm 1 (zeros without words).

    embedder adds the column embedding.
    """
    from veritide.functions import text as T

    if embedder is not None:
        return with_nulls(rows, embedder, {"embedding": "array<double>"})
    words = T.words(F.coalesce(F.col(text_col), F.lit("")))
    signed = F.transform(words, lambda w: F.struct(T.bucket(w, dims).alias("b"), T.sign(w).alias("s")))
    x = F.aggregate("_w", F.array_repeat(F.lit(0), dims), lambda a, w: F.transform(a, lambda v, i: F.when(i == w["b"], v + w["s"]).otherwise(v)))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v))
    some = rows.withColumn("_w", signed).withColumn("_x", x).withColumn("_norm", norm)
    unit = F.transform("_x", lambda v: F.when(F.col("_norm") > 0, v / F.col("_norm")).otherwise(0.0))
    return some.select(*rows.columns, unit.alias("embedding"))


def contradicting(pairs: DataFrame, scorer: Model | None = None) -> DataFrame:
    """``pairs`` (claim_a, claim_b) that contradict each other by the scorer's boolean contradicts; none without one."""
    got = with_nulls(pairs, scorer, {"contradicts": "boolean"})
    return got.where("contradicts").drop("contradicts")

"""Fuzzy best matches of names against a list of truths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_matches(names: DataFrame, truth: DataFrame, cutoff: float = 0.35, block: int = 100_000) -> DataFrame:
    """(name, truth, ratio): the best of the truth names by sequence matching, if it reaches ``cutoff``.

    The truth list is analyst-made and small; a longer one goes to the tasks in blocks of about ``block``
    names, and the best of all blocks counts.  The cut-off is taken on the names as they are, the ratio
    reported on lower case; ties go to the first name in order.  Several names may match one truth, and
    repeated names each give their row.
    """
    truth = truth.toDF("truth").where("truth <> ''").distinct()
    n = max(1, -(-truth.count() // block))
    out = None
    for k in range(n):
        part = truth if n == 1 else truth.where(F.pmod(F.xxhash64("truth"), F.lit(n)) == k)
        table = sorted(r.truth for r in part.collect())

        def run(batches, table=table):
            from difflib import SequenceMatcher

            for b in batches:
                out = []
                for name in b.column(0).to_pylist():
                    best = None
                    for g in table:
                        m = SequenceMatcher(None, name or "", g)
                        if m.real_quick_ratio() < cutoff or m.quick_ratio() < cutoff:
                            continue
                        r = m.ratio()
                        if r >= cutoff and (best is None or r > best[0]):
                            best = (r, g)
                    if best:
                        low = SequenceMatcher(None, (name or "").lower(), best[1].lower()).ratio()
                        out.append((name, best[1], round(low, 3), best[0]))
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["name", "truth", "ratio", "raw"])

        asked = names.select("name") if n == 1 else names.select("name").distinct()
        found = asked.mapInArrow(run, "name string, truth string, ratio double, raw double")
        out = found if out is None else out.unionByName(found)
    if n == 1:
        return out.select("name", "truth", "ratio")
    best = out.groupBy("name").agg(F.min(F.struct((-F.col("raw")).alias("k"), "truth", "ratio")).alias("b"))
    best = best.select(F.col("name").alias("_name"), "b.truth", "b.ratio")
    return names.select("name").join(best, F.col("name").eqNullSafe(F.col("_name"))).select("name", "truth", "ratio")

"""Language identification: family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritide.llm import chars
from veritide.llm.shared import held_out, lean, read, ship

#: Families of language codes; a code that is not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl", "be", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
BITS = 11
DIM = 1 << BITS
UNKNOWN = "und"


def _grams(text: str) -> tuple[np.ndarray, ...] | None:
    """Buckets of the two- and three-letter grams of the lower-cased words; None where there is no letter."""
    p = chars.folded(chars.points(text))
    keep = np.empty(len(p), bool)
    keep[:1] = True
    np.not_equal(p[1:], 32, out=keep[1:])
    keep[1:] |= p[:-1] != 32
    p = p[keep]  # runs of other characters are one
    if not len(p) or not (p != 32).any():
        return None
    p = np.concatenate([[32], p, [32]]).astype(np.uint32)
    two = p[:-1] * np.uint32(0x9E3779B1) + p[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + p[2:]
    return tuple(((g * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)) for g in (two, three))


def vector(text: str | None) -> np.ndarray | None:
    """Square roots of gram shares, of norm about 1; None where the text is null or has no letter."""
    grams = _grams(text) if text else None
    if grams is None:
        return None
    counts = np.concatenate([np.bincount(g, minlength=DIM) for g in grams]).astype(np.float32)
    return np.sqrt(counts / counts.sum())


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, lam: float = 1e-4, epochs: int = 15, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine: Pegasos in batches, averaged.

    rows: those of x to learn from, y their signs; the last column of x is 1.  x is not copied.
    """
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    w, total, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float64), 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            t += 1
            rate = 1 / (lam * (t + 100))
            part = x[rows[some]]
            bad = y[some] * (part @ w) < 1
            w *= 1 - rate * lam
            if bad.any():
                w += rate / len(some) * ((y[some] * weight[some])[bad] @ part[bad])
            if epoch >= epochs // 2:
                total += w
    return (total / max(1.0, np.linalg.norm(total))).astype(np.float32) if total.any() else total.astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    #: One-versus-rest weights of families, then one-versus-one weights of pairs inside each.
    family: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.langs:
            return UNKNOWN, 0.0
        margin = lambda w: float(x @ w[:-1] + w[-1])
        confident = 1.0
        inside = self.langs
        if len(self.families) > 1:
            by = sorted(((margin(self.family[f]), f) for f in self.families), reverse=True)
            chosen = by[0][1]
            confident = 1 / (1 + np.exp(-20 * (by[0][0] - by[1][0])))
            inside = [c for c in self.langs if FAMILY_OF.get(c, c) == chosen]
        votes = {c: [0, 0.0] for c in inside}
        for a, b in combinations(inside, 2):
            m = margin(self.pairs[a, b])
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = min(inside, key=lambda c: (-votes[c][0], -votes[c][1], c))
        if len(inside) > 1:
            confident *= 1 / (1 + np.exp(-20 * votes[best][1] / (len(inside) - 1)))
        return best, float(confident)


def fit(x: np.ndarray, lang: list[str]) -> Model:
    """Fit on rows of ``vector`` with a last column of ones."""
    langs = sorted(set(lang))
    who, kin = np.array(lang), np.array([FAMILY_OF.get(c, c) for c in lang])
    model = Model(langs, sorted(set(kin.tolist())))
    sign = lambda a: np.where(a, 1, -1).astype(np.float32)
    if len(model.families) > 1:
        model.family = {f: svm(x, np.arange(len(x)), sign(kin == f)) for f in model.families}
    for a, b in combinations(langs, 2):
        if FAMILY_OF.get(a, a) == FAMILY_OF.get(b, b):
            two = np.flatnonzero((who == a) | (who == b))
            model.pairs[a, b] = svm(x, two, sign(who[two] == a))
    return model


def sample(known: DataFrame, bound: int, total: int, languages: int | None = None) -> DataFrame | None:
    """(_id, _lang): for each language the rows with the smallest hashes of their id; None without a language.

    One pass counts the languages, one picks: of large languages only about twice the bound passes a
    first cut by hash, so that no task ranks more than that.
    """
    ids = known.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    sizes = ids.groupBy("_lang").count().orderBy(F.desc("count"), "_lang")
    sizes = (sizes if languages is None else sizes.limit(languages)).collect()
    if not sizes:
        return None
    share = max(50, min(bound, total // len(sizes)))
    wide = lambda n: n > 2 * share + 1000
    below = {c: int(-(2.0**63) + 2.0**64 * (2 * share + 500) / n) if wide(n) else (1 << 63) - 1 for c, n in sizes}
    limit = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    h = F.xxhash64(F.col("_id").cast("string"), F.lit("sample"))
    order = Window.partitionBy("_lang").orderBy(h, "_id")
    few = ids.where(h <= F.try_element_at(limit, F.col("_lang")))
    return few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= share).select("_id", "_lang").distinct()


def train(docs: DataFrame, bound: int = 1000, total: int = 4000, languages: int | None = None) -> Model:
    """Fit on at most ``bound`` documents of each language (``total`` in all, or 50 of each), picked by the hash of their id, none held out.

    All languages are learned, or the ``languages`` most frequent where that is given.  Rows without id, text, letters or lang teach nothing;
    of rows that repeat with id and lang one is learned.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    picked = sample(known, bound, total, languages)
    if picked is None:
        return fit(np.zeros((0, 2 * DIM + 1), np.float32), [])
    rows = known.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.col("lang").alias("_lang")).join(
        F.broadcast(picked.withColumnRenamed("_lang", "_of")), (F.col("_doc") == F.col("_id")) & (F.col("_lang") == F.col("_of"))
    )  # at most ``total`` pairs, or 50 of each language

    def run(batches):
        for b in batches:
            made = [vector(t) for t in b.column(0).to_pylist()]
            made = [None if v is None else v.astype(np.float16).tobytes() for v in made]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), b.column(1), b.column(2)], ["x", "lang", "id"])

    made = rows.select("_text", "_lang", F.col("_doc").cast("string")).mapInArrow(lean(run), "x binary, lang string, id string")
    one = made.where("x IS NOT NULL").groupBy("id", "lang").agg(F.min("x").alias("x"))
    got = sorted(one.collect(), key=lambda r: (r.id, r.lang, r.x))
    x = np.ones((len(got), 2 * DIM + 1), np.float32)
    for i, r in enumerate(got):
        x[i, :-1] = np.frombuffer(r.x, np.float16)
    return fit(x, [r.lang for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text where nothing
    could be learned.  Repeated rows get equal results; a null doc_id stays null; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = []
            for t in b.column(1).to_pylist():
                v = vector(t)
                got.append((UNKNOWN, 0.0) if v is None else model.predict(v))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ship(spark)
    return identify(docs, train(docs))

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm import chars
from veritide.llm.shared import bounded_sample, held_out, lean, read, ship

WORDS = 1 << 12  # buckets of hashed words
STATS = 16
RANK = 6


@dataclass
class Machine:
    """y = b + w.x + sum over factors of ((v.x)^2 - v^2.x^2) / 2, which is linear in the non-zero entries of x."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, idx: np.ndarray, val: np.ndarray) -> float:
        v = self.v[idx]
        s = val @ v
        return self.bias + float(val @ self.w[idx]) + 0.5 * float((s * s).sum() - ((val * val) @ (v * v)).sum())


_BUCKET: dict = {}


def _bucket(word: str) -> int:
    got = _BUCKET.get(word)
    if got is None:
        if len(_BUCKET) > 100_000:
            _BUCKET.clear()
        got = _BUCKET[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & (WORDS - 1)
    return got


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their weights of norm 1, raw structure statistics and metadata)."""
    text = text or ""
    words = text.split()
    at = np.fromiter(map(_bucket, words), np.int64, len(words))
    counts = np.bincount(at, minlength=WORDS)
    idx = np.flatnonzero(counts)
    top = int(counts.max())
    val = np.log1p(counts[idx])
    val = val / math.sqrt(float(val @ val)) if len(idx) else val
    n = max(1, len(text))
    share = np.bincount(chars.classes(chars.points(text)), minlength=10)[:10] / n
    w = max(1, len(words))
    twice = int((at[1:] == at[:-1]).sum()) if len(at) > 1 else 0
    said = n_chars if n_chars is not None and n_chars >= 0 else len(text)
    stats = [math.log1p(len(text)), math.log1p(said), len(text) / w, len(idx) / min(w, WORDS), top / w, twice / w]
    return idx, val, np.array([*stats, *share])


class Rows:
    """Feature rows of Arrow batches (id, text, n_chars), as dense as they need to be."""

    def __init__(self, m: Machine):
        self.m, self.tail = m, np.arange(WORDS, WORDS + STATS)

    def logit(self, text, n_chars) -> float:
        idx, val, stats = features(text, n_chars)
        z = np.clip((stats - self.m.mean) / self.m.scale, -4, 4) / 4
        return self.m.logit(np.concatenate([idx, self.tail]), np.concatenate([val, z]))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, seed: int = 7) -> Machine:
    """Adam on the log loss, in batches of 256; one class alone gives a constant score, no rows one half."""
    y = np.array([r[3] for r in rows], np.float32)
    m = Machine(0.0, np.zeros(WORDS + STATS, np.float32), np.zeros((WORDS + STATS, RANK), np.float32), np.zeros(STATS), np.ones(STATS))
    if len(rows) == 0:
        return m
    stats = np.stack([r[2] for r in rows])
    m.mean, m.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    m.bias = math.log(prior / (1 - prior))
    if y.min() == y.max():
        return m
    rng = np.random.default_rng(seed)
    m.v = rng.normal(0, 0.05, m.v.shape).astype(np.float32)
    z = (np.clip((stats - m.mean) / m.scale, -4, 4) / 4).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            x = np.zeros((len(some), WORDS + STATS), np.float32)
            for i, r in enumerate(some):
                x[i, rows[r][0]] = rows[r][1]
            x[:, WORDS:] = z[some]
            s, x2 = x @ m.v, x * x
            logit = m.bias + x @ m.w + 0.5 * ((s * s).sum(1) - (x2 @ (m.v * m.v)).sum(1))
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[some]) / len(some)
            m.bias -= 0.3 * float(g.sum())
            grads = (x.T @ g + 1e-5 * m.w, x.T @ (g[:, None] * s) - (x2.T @ g)[:, None] * m.v + 1e-4 * m.v)
            step += 1
            for p, d, (a, b) in zip((m.w, m.v), grads, state, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, bound: int = 6000) -> Machine:
    """Fit on at most ``bound`` labelled documents that are not held out, picked by the hash of their id.

    labels: doc_id and quality 0/1; null and other values are left out.  Of rows that repeat with doc_id and
    label one is learned, that with the smallest features, so no more than two rows of an id reach the driver.
    """
    picked = labels.where(F.col("quality").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    picked = bounded_sample(picked.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")), "_id", bound)
    rows = docs.select(F.col("doc_id").alias("_doc"), _text(docs), _said(docs)).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))  # at most ``bound`` pairs of numbers

    def run(batches):
        for b in batches:
            got = [features(t, n) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0].astype(np.int16).tobytes() for g in got], pa.binary()),
                    pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary()),
                    pa.array([g[2].tobytes() for g in got], pa.binary()),
                    b.column(2),
                    b.column(3),
                ],
                ["idx", "val", "stats", "y", "id"],
            )

    made = rows.select("_text", "_n", "_y", F.col("_doc").cast("string")).mapInArrow(
        lean(run), "idx binary, val binary, stats binary, y int, id string"
    )
    one = made.groupBy("id", "y").agg(F.min(F.struct("idx", "val", "stats")).alias("f")).select("id", "y", "f.*")
    table = sorted(one.collect(), key=lambda r: (r.id, r.idx, r.y))
    return fit(
        [(np.frombuffer(r.idx, np.int16).astype(np.int64), np.frombuffer(r.val, np.float32), np.frombuffer(r.stats), r.y) for r in table]
    )


def _text(docs: DataFrame):
    return F.col("text").cast("string").alias("_text")


def _said(docs: DataFrame):
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return n.alias("_n")


def score(
    docs: DataFrame, machine: Machine, threshold: float = 0.3, keep: list[str] | None = None, accepted: bool = False
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, or the columns ``keep`` and score and predicted.

    Null text counts as empty and is scored too; a null or negative n_chars counts as the text's length.
    Repeated rows get equal scores; a null doc_id stays null; an empty table gives no rows.  With
    ``accepted`` the columns ``keep`` of the rows predicted 1 come back.  A kept text goes to the workers once.
    """
    ship(docs.sparkSession)
    held = machine
    keep = keep or ["doc_id"]
    sent = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    at = []
    for name, kind, made in (("text", "string", _text), ("n_chars", "bigint", _said)):
        if name in keep and docs.schema[name].dataType.simpleString() == kind:
            at.append(keep.index(name))
        else:
            at.append(len(sent))
            sent.append(made(docs))
    kept = docs.select(*sent)
    kinds = [f.dataType.simpleString() for f in kept.schema.fields[: len(keep)]]
    text_at, said_at = at

    def run(batches):
        rows = Rows(held)
        for b in batches:
            pairs = zip(b.column(text_at).to_pylist(), b.column(said_at).to_pylist(), strict=True)
            z = [rows.logit(t, n) for t, n in pairs]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -40, 40)))
            own = b.columns[: len(keep)]
            out = pa.RecordBatch.from_arrays([*own, pa.array(p, pa.float64())], [f"_k{i}" for i in range(len(keep))] + ["_score"])
            yield out.filter(pa.array(p >= threshold)) if accepted else out

    schema = ", ".join(f"_k{i} {k}" for i, k in enumerate(kinds)) + ", _score double"
    out, own = kept.mapInArrow(lean(run), schema), [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    if accepted:
        return out.select(*own)
    out = out.select(*own, F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
    return out if keep != ["doc_id"] else out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ship(spark)
    return score(docs, train(docs, read(spark, sf_dir, "labels")))

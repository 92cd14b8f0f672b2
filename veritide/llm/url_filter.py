"""URL verdicts: prefix rules, and gradient-boosted trees on lexical features for what no rule fits."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.shared import bounded_sample, lean, read, ship

#: The rules of the registered query, as (rule, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(h: Column, p: Column, rules) -> Column:
    """The longest fitting rule, or null; meant for lists of some hundred rules."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


@dataclass(frozen=True)
class Parts:
    scheme: str
    host: str
    path: str
    query: str
    fragment: bool

    @property
    def segments(self) -> list[str]:
        return [s for s in self.path.split("/") if s]


def parts(url: str) -> Parts:
    """The parts of a URL; without "://" all of it is host, path and query."""
    scheme, sep, rest = url.partition("://")
    if not sep:
        scheme, rest = "", url
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    front, mark, _ = rest[cut:].partition("#")
    p, _, query = front.partition("?")
    return Parts(scheme, rest[:cut].lower(), p, query, bool(mark))


def lexical(url: str, suffix: dict[str, float]) -> list[float]:
    """Length, depth, digit ratio, entropy, parameter counts and suffix statistics of one URL."""
    u = parts(url)
    n, labels, segments = max(1, len(url)), u.host.split("."), u.segments
    return [
        len(url), len(u.host), len(u.path), len(labels), len(segments), sum(c.isdigit() for c in url) / n,
        -sum(k / n * math.log2(k / n) for k in Counter(url).values()),
        u.query.count("&") + bool(u.query), len(u.query), float(u.fragment), float(u.scheme == "https"),
        u.host.count("-"), max(map(len, labels)), max(map(len, segments), default=0),
        float(u.path.endswith("/")), float("." in (segments[-1] if segments else "")),
        *(suffix.get(key, suffix.get("", 0.5)) for key in suffixes(u.host, segments)),
    ]


def suffixes(name: str, segments: list[str]) -> list[str]:
    labels = name.split(".")
    return [labels[-1], ".".join(labels[-2:]), labels[-1] + "/" + (segments[0] if segments else "")]


@dataclass
class Trees:
    """Boosted depth-limited trees for the log loss; a node is (feature, threshold, left, right) or a leaf value."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    suffix: dict = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _walk(tree, x)
        return out


def _walk(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, at, left, right = node
    goes = x[:, f] <= at
    out = np.empty(len(x))
    out[goes], out[~goes] = _walk(left, x[goes]), _walk(right, x[~goes])
    return out


def _grow(bins, edges, g, h, rows, depth, rate, least):
    value = rate * -g[rows].sum() / (h[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 2 * least:
        return value
    score = lambda a, b: a * a / (b + 1.0)
    best = (1e-6, None)
    for f in range(bins.shape[1]):
        k = len(edges[f])
        if not k:
            continue
        b = bins[rows, f]
        sums = [np.cumsum(np.bincount(b, weights=w, minlength=k + 1))[:k] for w in (g[rows], h[rows], np.ones(len(rows)))]
        tg, th = g[rows].sum(), h[rows].sum()
        gain = score(sums[0], sums[1]) + score(tg - sums[0], th - sums[1]) - score(tg, th)
        gain[(sums[2] < least) | (len(rows) - sums[2] < least)] = -1
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], (f, i))
    if best[1] is None:
        return value
    f, i = best[1]
    left = bins[rows, f] <= i
    sides = (_grow(bins, edges, g, h, r, depth - 1, rate, least) for r in (rows[left], rows[~left]))
    return (f, float(edges[f][i]), *sides)


def suffix_statistics(urls: list[str], y: np.ndarray, prior: float, least: int = 5) -> dict[str, float]:
    """The smoothed mean label of each suffix that ``least`` URLs have; the prior under the empty key."""
    seen: dict[str, list] = {}
    for url, v in zip(urls, y, strict=True):
        u = parts(url)
        for key in suffixes(u.host, u.segments):
            a = seen.setdefault(key, [0, 0.0])
            a[0] += 1
            a[1] += v
    return {k: (s + 5 * prior) / (n + 5) for k, (n, s) in seen.items() if n >= least} | {"": prior}


def fit(urls: list[str], y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, least: int = 5) -> Trees:
    """Fit on labelled URLs (1: allow).  One class alone gives a constant; no URLs allow everything.

    The trees see each URL with the suffix statistics of the other folds, never with its own label.
    """
    if not len(urls):
        return Trees(base=1.0)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(math.log(prior / (1 - prior)))
    if y.min() == y.max():
        return model
    model.suffix = suffix_statistics(urls, y, prior)
    fold = np.arange(len(urls)) % 5
    x = np.empty((len(urls), len(lexical("", model.suffix))))
    for k in range(5):
        other = np.flatnonzero(fold != k)
        known = suffix_statistics([urls[i] for i in other], y[other], prior)
        for i in np.flatnonzero(fold == k):
            x[i] = lexical(urls[i], known)
    edges = []
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1]))
        edges.append(cuts[cuts < x[:, f].max()])
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(bins, edges, p - y, p * (1 - p), np.arange(len(x)), depth, rate, least)
        model.trees.append(tree)
        z += _walk(tree, x)
    return model


def train(labelled: DataFrame, bound: int = 10_000) -> Trees:
    """Fit on at most ``bound`` distinct URLs of (url, label 0/1), picked by their hash; rows with nulls teach nothing."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).groupBy("url").agg(F.max("label").alias("label"))
    got = sorted(bounded_sample(rows, "url", bound).collect())
    return fit([r[0] for r in got], np.array([float(r[1]) for r in got]))


def judge(pages: DataFrame, rules=RULES, model: Trees | None = None, bound: int = 10_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; the trees decide where no rule fits.

    Without a model one is trained on the URLs that rules fit, with the rules' verdicts as labels.  score:
    the trees' probability of allow, null where a rule decides.  A null URL, or one without "://", has an
    empty host and path and no rule; its text (null: empty) is scored like any other.  Repeated rows get
    equal results; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    base = pages.select("page_id", F.col("url").cast("string").alias("url"))
    base = base.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    base = base.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, verdict).otherwise(said)
    base = base.withColumn("_said", said)
    if model is None:
        model = train(base.where("_said IS NOT NULL").select("url", (F.col("_said") == "allow").cast("int").alias("label")), bound)
    held = model

    def run(batches):
        for b in batches:
            urls, fixed = b.column(1).to_pylist(), b.column(5).to_pylist()
            at = [i for i, s in enumerate(fixed) if s is None]
            scores: list = [None] * len(urls)
            if at:
                x = np.array([lexical(urls[i] or "", held.suffix) for i in at])
                p = 1 / (1 + np.exp(-held.logit(x)))
                for i, v in zip(at, p.tolist(), strict=True):
                    scores[i] = v
            verdict = [s or ("allow" if v >= 0.5 else "block") for s, v in zip(fixed, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), b.column(4), pa.array(verdict, pa.string()), pa.array(scores, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return base.mapInArrow(lean(run), f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))

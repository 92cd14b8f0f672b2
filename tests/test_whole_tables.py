"""Queries over whole tables, against brute force."""

import re
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from veritide.functions import text as T
from veritide.operators import fuzzy
from veritide.operators import retrieval as R
from veritide.plans import catalog


def test_token_overlap_over_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", T.source_words(F.col("text")).alias("w")).collect()
    sets = {r.doc_id: frozenset(r.w or ()) for r in docs}
    links, pairs = dict.fromkeys(sets, 0), 0
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and 0.75 * len(x) <= len(y) and 0.75 * len(y) <= len(x) and len(x & y) >= 0.75 * len(x | y):
            links[a], links[b], pairs = links[a] + 1, links[b] + 1, pairs + 1
    assert pairs == 188
    got = catalog.QUERIES["token_overlap_all"](spark, sf).collect()
    assert len(got) == len(docs) and {r.source_id: r.links for r in got} == links
    assert all(sets[r.class_id] == sets[r.source_id] and r.class_id <= r.source_id for r in got)
    share = {}
    for r in docs:
        share.setdefault(r.source, []).append(links[r.doc_id] > 0)
    for r in catalog.QUERIES["source_independence_all"](spark, sf).collect():
        own = share.pop(r.source)
        assert r.n == len(own) and abs(r.independence - (1 - sum(own) / len(own))) < 6e-4
    assert not share


def test_vector_scores_in_blocks(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("id < 9").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    whole, blocks = (sorted(map(tuple, R.vector_scores(e, q, n).collect())) for n in (100, 2))
    assert whole == blocks and len(whole) == 9 * e.count()


def test_hybrid_over_all_rows(spark):
    sf, dense = "/root/testdata/sf0.001", {}
    for table, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        rows = R.sparse_embedding(spark.read.parquet(f"{sf}/{table}.parquet"), key, T.words(F.col("text")), 256).collect()
        for r in rows:
            dense.setdefault((table, r.id), {})[r.bucket] = r.weight
    best = {}
    for r in catalog.QUERIES["bm25_topk"](spark, sf).collect():
        best.setdefault(r.q, {}).setdefault(r.id, []).append(r["rank"])
    for q in best:
        ask = dense["benchmark", q]
        cos = sorted((-sum(round(x * 1e6) * round(w.get(b, 0) * 1e6) for b, x in ask.items()), i) for (table, i), w in dense.items() if table == "documents")
        for rank, (_, i) in enumerate(cos[:10], 1):
            best[q].setdefault(i, []).append(rank)
    got = catalog.QUERIES["hybrid_retrieve"](spark, sf).collect()
    assert len(got) == 10 * len(best) and any(r.id % 2 and r.id % 3 for r in got)
    assert all(abs(r.score - sum(1 / (60 + k) for k in best[r.q][r.id])) < 1e-7 for r in got)


def brute_chunks(text, size=1000, overlap=200):
    """Sentences packed one by one; long ones cut at words."""
    long = lambda parts: sum(len(p) + 1 for p in parts)
    done, cur = [], []
    for s in (x.strip(" ") for x in re.split(r"(?<=[.!?])\s+", text or "", flags=re.ASCII)):
        if not s:
            continue
        if len(s) > size:
            if cur:
                done.append(" ".join(cur))
            cur, line = [], ""
            for w in re.split(r"\s+", s, flags=re.ASCII):
                if line and len(line) + 1 + len(w) > size:
                    done.append(line)
                    line = w
                else:
                    line = f"{line} {w}" if line else w
            if line:
                done.append(line)
        elif not cur or long(cur) + len(s) <= size:
            cur.append(s)
        else:
            done.append(" ".join(cur))
            kept = []
            for p in reversed(cur):
                if long(kept) + len(p) > overlap:
                    break
                kept.insert(0, p)
            cur = [*kept, s]
    return [*done, " ".join(cur)] if cur else done


def test_chunks_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = ["", None, "x" * 2500, "One. " * 400, "word " * 700 + "end. Then a short one. " * 20, "a.\n\nb?  c!"]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10_000 + i, t, "en") for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    want = {r.doc_id: brute_chunks(r.text) for r in df.collect()}
    got = {}
    for r in R.chunks(df, "doc_id", "text").orderBy("id", "chunk_no").collect():
        assert r.chunk_id == f"{r.id}::chunk_{len(got.setdefault(r.id, []))}"
        got[r.id].append(r.chunk)
    assert got == {i: c for i, c in want.items() if c}
    tier = {r.doc_id: {"en": 1, "de": 2}.get(r.lang, 3) for r in docs.collect()}
    rows = catalog.QUERIES["index_chunks"](spark, sf).collect()
    assert {(r.chunk_id, r.chunk, r.tier, r.source_type) for r in rows} == {
        (f"{i}::chunk_{k}", c, tier[i], "primary" if tier[i] == 1 else "secondary") for i, cs in want.items() if i < 10_000 for k, c in enumerate(cs)
    }


def test_mmr_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = set()
    for q in (i for i in e if i % 100 == 0):
        rel = {i: round(max(0.0, (1 + float(e[q] @ v)) / 2), 6) for i, v in e.items() if i != q}
        top = sorted(rel, key=lambda i: (-rel[i], i))[:10]
        chosen = []
        while len(chosen) < 5:
            gain = lambda i: round(0.5 * rel[i] - 0.5 * max((float(e[i] @ e[j]) for j in chosen), default=0.0), 9)
            chosen.append(max((i for i in top if i not in chosen), key=lambda i: (gain(i), -top.index(i))))
        want |= {(q, i, k) for k, i in enumerate(chosen, 1)}
    assert {tuple(r) for r in catalog.QUERIES["mmr"](spark, sf).select("q", "id", "pick").collect()} == want


def test_fuzzy_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeF "), rng.integers(3, 12)))
    names, truth = [word() for _ in range(40)] + [None, ""], sorted({word() for _ in range(30)})
    names.append(names[0])
    want = []
    for n in names:
        r, g = max(((SequenceMatcher(None, n or "", g).ratio(), g) for g in truth), key=lambda x: (x[0], [-ord(c) for c in x[1]], -len(x[1])))
        if r >= 0.35:
            want.append((n, g, round(SequenceMatcher(None, (n or "").lower(), g.lower()).ratio(), 3)))
    df, t = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(g,) for g in truth], "truth string")
    for block in (1000, 7):
        got = [tuple(r) for r in fuzzy.best_matches(df, t, block=block).collect()]
        ratio = lambda rows: sorted((str(n), r) for n, _, r in rows)
        assert sorted(map(str, got)) == sorted(map(str, want)) or ratio(got) == ratio(want)

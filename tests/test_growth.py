"""Steps that once grew faster than their input, against brute force."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from veritide.operators import source_quality as Q


def test_token_links_meet_by_size_and_place(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = list(rng.choice(words, rng.integers(4, 30), replace=False))
        for _ in range(3):
            texts.append(" ".join(base))
            base[rng.integers(len(base))] = f"rare{rng.integers(30)}"
    texts += [None, "", "a b c", texts[0]]
    sets = [frozenset(w for w in (t or "").split() if len(w) >= 4) for t in texts]
    links = [0] * len(sets)
    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
            links[i], links[j] = links[i] + 1, links[j] + 1
    df = spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")
    for common in (1_000_000, 20, 0):  # the order by frequency is known, known in part, not known
        assert {r.source_id: r.links for r in Q.token_links(df, common=common).collect()} == dict(enumerate(links))

    # sets of one common word and different sizes don't meet, at whatever bound of memory
    import pyarrow as pa

    n = np.sort(rng.integers(1, 400, 500))
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(500, np.int64), np.arange(500), n.astype(np.int32), np.zeros(500, np.int32))], ["t", "i", "n", "p"])
    want = {(a, b) for a, b in combinations(range(500), 2) if n[a] >= 0.75 * n[b] - 1e-9}
    for most in (50, 1_000_000):
        parts = list(Q._meeting(0.75, most)([rows.slice(0, 7), rows.slice(7)]))
        assert {x for p in parts for x in zip(*(c.to_pylist() for c in p.columns), strict=True)} == want
        assert max(p.num_rows for p in parts) <= max(most, 500)


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    import struct

    from veritide.plans import catalog

    spark.createDataFrame([(1, [-8.9e-8, 0.0, -0.0, 0.0078125, -0.5], 3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    (row,) = catalog.QUERIES["sink_vector_index"](spark, str(tmp_path)).collect()
    assert struct.pack("5d", *row.v) == struct.pack("5d", -0.0, 0.0, -0.0, 0.007813, -0.5)


def test_bm25_topk_equals_all_scores(spark):
    from veritide.operators import retrieval as R

    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.6, n) % 40)
    docs = spark.createDataFrame([(i, text(rng.integers(1, 40)) if i % 9 else None, i % 2) for i in range(200)] + [(200, "", 0)], "d long, t string, part int")
    asked = spark.createDataFrame([(i, text(rng.integers(1, 8))) for i in range(12)] + [(12, "none"), (13, None)], "i long, t string")
    for where in (None, F.col("part") == 1):
        want = R.ranked(R.bm25(docs, asked, "d", "t", "i", "t", where), 5).collect()
        for cells in (50, 2_000_000):
            got = R.bm25_topk(docs, asked, "d", "t", "i", "t", 5, where, cells).collect()
            assert sorted((r.q, r.id, r.score, r["rank"]) for r in got) == sorted((r.q, r.id, r.score, r["rank"]) for r in want)


def test_tier_counts_each_signal_once(spark, sf):
    from veritide.plans import catalog

    plan = catalog.QUERIES["tier_classify"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("accuracy|precision") == 1


def test_vector_topk_and_golden_groups_equal_all_pairs(spark):
    from veritide.operators import retrieval as R

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)], int(rng.integers(3)), float(rng.integers(0, 4))) for i in range(150)]
    e = spark.createDataFrame(rows, "id long, v array<float>, grp int, relevance double")
    q = e.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), "grp")
    want = R.ranked(R.vector_scores(e.select("id", "v"), q.select("q", "qv")).where("q <> id"), 6)
    key = lambda df: sorted(tuple(r[c] for c in ("q", "id", "score", "rank")) for r in df.collect())
    for most, cells in ((10_000, 4_000_000), (4, 100)):
        got = R.vector_topk(e.select("id", "v"), q.select("q", "qv"), 6, True, most, cells)
        assert key(got) == key(want)
    assert R.vector_topk(e.select("id", "v"), q.select("q", "qv").limit(0), 6).count() == 0
    gold = q.select("q", "grp").join(e.select("id", "grp", "relevance"), "grp").where("q <> id")
    metrics = lambda df: sorted((r.q, r.hit_rate, r.mrr, r.ndcg) for r in df.collect())
    assert metrics(R.ir_metrics_by_group(want, q.select("q", "grp"), e.select("id", "grp", "relevance"))) == metrics(R.ir_metrics(want, gold))


def test_vector_topk_keeps_no_more_than_it_ranks(spark, monkeypatch):
    from veritide.operators import retrieval as R

    rng = np.random.default_rng(4)
    nan, inf = float("nan"), float("inf")
    v = np.round(rng.normal(size=(400, 4)), 1)
    v[rng.random(400) < 0.3] = [0.5, 0.5, 0.5, 0.5]  # copies
    v[50:60] *= 1e6
    v[60:70] *= -1000
    v[70:73] = [[nan, 0, 0, 0], [inf, 0, 0, 0], [-inf, 1, 0, 0]]
    same = rng.permutation(400)
    rows = [(int(i), [float(x) for x in v[i]]) for i in same]
    for odd in (True, False):
        e = spark.createDataFrame([r for r in rows if odd or not 70 <= r[0] < 73], "id long, v array<float>").repartition(3)
        q = e.where("id % 9 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
        want = R.ranked(R.vector_scores(e, q).where("q <> id"), 6).collect()
        for cells in (4_000_000, 300):
            got = R.vector_topk(e, q, 6, True, cells=cells).collect()
            assert sorted((r.q, r["rank"], r.id, str(r.score)) for r in got) == sorted((r.q, r["rank"], r.id, str(r.score)) for r in want)

    copies = spark.range(3000).repartition(7).selectExpr("id", "array(0.6F, 0.8F) v")
    asked = copies.where("id < 30").selectExpr("id q", "v qv")
    got = R.vector_topk(copies, asked, 5, True, tasks=1).collect()
    assert {(r.q, r.id) for r in got} == {(a, b) for a in range(30) for b in [x for x in range(6) if x != a][:5]}
    # the tasks, one to a core at most, hand on so many rows, whatever the files and copies
    monkeypatch.setattr(R, "ranked", lambda scores, k: scores)
    assert R.vector_topk(copies, asked, 5, True, tasks=1).count() <= spark.sparkContext.defaultParallelism * 30 * 5


def test_mmr_among_ties_below_zero(spark, tmp_path):
    from veritide.plans import catalog

    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=(500, 3)) * 2, 1)
    v[:, 0] = np.abs(v[:, 0]) + 2
    v[::100, 0] *= -2  # these ask; with nearly all others their products are below -1, where each score is 0
    e = spark.createDataFrame([(int(i), [float(x) for x in v[i]], 0) for i in rng.permutation(500)], "vec_id long, embedding array<float>, label int")
    e.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = v.astype(np.float32).astype(float)
    want = set()
    for q in range(0, 500, 100):
        score = np.round(np.maximum(0, (1 + v @ v[q]) / 2), 6)
        top = [i for i in np.lexsort((np.arange(500), -score)) if i != q][:10]
        chosen = []
        while len(chosen) < 5:
            gain = [-np.inf if i in chosen else round(0.5 * score[i] - 0.5 * max((v[i] @ v[j] for j in chosen), default=0), 9) for i in top]
            chosen.append(top[int(np.argmax(gain))])
            want.add((q, int(chosen[-1]), len(chosen)))
    assert {(r.q, r.id, r.pick) for r in catalog.QUERIES["mmr"](spark, str(tmp_path)).collect()} == want


def test_metrics_search_once(spark, sf):
    from veritide.plans import catalog

    for name in ("mrr", "ndcg", "hit_rate"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_metrics_among_ties_below_zero(spark, tmp_path):
    from veritide.plans import catalog

    rng = np.random.default_rng(12)
    v = np.round(rng.normal(size=(500, 3)) * 2, 1)
    v[:, 0] = np.abs(v[:, 0]) + 2
    v[::100, 0] *= -2
    label = rng.integers(0, 3, 500)
    label[100] = 7  # a query without golden rows
    e = spark.createDataFrame([(int(i), [float(x) for x in v[i]], int(label[i])) for i in rng.permutation(500)], "vec_id long, embedding array<float>, label int")
    e.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = v.astype(np.float32).astype(float)
    got = {n: {r.q: r[n] for r in catalog.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("ndcg", "hit_rate")}
    for q in range(0, 500, 100):
        score = np.round(np.maximum(0, (1 + v @ v[q]) / 2), 6)
        top = [i for i in np.lexsort((np.arange(500), -score)) if i != q][:10]
        gain = {i: 1.0 + i % 3 for i in range(500) if i != q and label[i] == label[q]}
        if not gain:
            assert got["ndcg"][q] is None and got["hit_rate"][q] is None
            continue
        ideal = sum(x / np.log2(n + 2) for n, x in enumerate(sorted(gain.values(), reverse=True)))
        assert abs(got["ndcg"][q] - sum(gain.get(i, 0) / np.log2(n + 2) for n, i in enumerate(top)) / ideal) < 6e-5
        assert abs(got["hit_rate"][q] - sum(i in gain for i in top) / len(gain)) < 6e-5


def _most_rows(df) -> int:
    """The most rows that any step of the executed plan puts out."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        rows = p.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_metrics_list_no_pairs(spark, tmp_path):
    from veritide.plans import catalog

    rng = np.random.default_rng(13)
    v = np.round(rng.normal(size=(3000, 4)), 1)
    v[rng.random(3000) < 0.3] = 0.5  # copies
    e = spark.createDataFrame([(i, [float(x) for x in v[i]], int(i % 10 == 9)) for i in range(3000)], "vec_id long, embedding array<float>, label int")
    e.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("ndcg", "hit_rate"):  # 30 queries, of one large label all
        assert 30 <= _most_rows(catalog.QUERIES[name](spark, str(tmp_path))) <= 3000

"""Cases in which an operator once did less than its whole job."""

import corpus_pipeline as C

from veritide.llm import decontaminate, languages, secrets
from veritide.llm.shared import new_path, read, written


def test_redact_whole_keys(spark):
    line, short = "MIIEpAIBAAKCAQEA7Vq+" + "Zk9/" * 11, "QmFzZTY0Kz=="
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = [line, line[::-1], short]
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0011", ""]
    texts = [
        "\n".join(["a b", begin, *body, end, "some words"]),
        "\r\n".join(["a b", begin, *fields, *body, end, "some words"]),
        "\\n".join(["a b", begin, *body, end, "some words"]),
        " ".join(["a b", begin, *body, end, "some words"]),
        "\n".join(["a b", begin, *body, "some words"]),
        "\n".join(["a b", begin, *fields, *body]),
        "\\n".join(["a b", begin, *body, "some words"]),
        "\n".join(["a b", begin, line, begin, *body, end, "some words"]),
        "a b\n" + begin + "\nsome words stay here",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df, new_path(spark, "ledger")).collect()}
    for i, t in got.items():
        assert not any(x in t for x in (line, line[::-1], short, "PRIVATE KEY", "DEK-Info")), (i, t)
        assert t.startswith("a b") and ("some words" in t) == ("some words" in texts[i]), (i, t)
    assert got[8] == "a b\n[SECRET]\nsome words stay here"


def test_short_items_leak(spark):
    items = ["What is 2 + 2?", "ab", "東京の人口は？", "x", "", None]
    texts = ["so, WHAT is 2+2", "what is 2 22", "abc cab", "ab-c", "私は東京の人口は知らない", "東京の人口", "x", "", None, "What is 2 + 3"]
    df, bench = (spark.createDataFrame(list(enumerate(x)), s) for x, s in ((texts, "doc_id long, text string"), (items, "item_id long, text string")))
    got = sorted(tuple(r) for r in decontaminate.leaks(df, bench).collect())
    assert got == [(0, 0, 0, 0, 14), (3, 1, 0, 0, 2), (4, 2, 0, 0, 8), (6, 3, 0, 0, 1)]


def test_pipeline_decides_by_row(spark):
    sf = "/root/testdata/sf0.001"
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    leak = read(spark, sf, "benchmark").first().text
    rows = [
        (None, a), (None, a), (None, a + " more"),  # one stays
        (1, b), (1, b), (2, b), (1, c), (3, c + " more"),  # the first and the last 1 stay
        (4, "other words " + a[::-1]), (4, leak), (None, leak), (None, None), (None, ""), (5, None), (5, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = written(C.near_duplicate(spark, docs, sf), "test-rows")
    assert got.columns == docs.columns
    texts = sorted((r.text or "", r.doc_id or 0) for r in got.collect())
    of = lambda t: [x for x in texts if x[0][:20] == t[:20]]
    assert len(of(a)) == 1 and of(b) == [(b, 1)] and of(c) == [(c, 1)] and len(of(leak)) == 1
    assert [i for t, i in texts if not t] == [0, 0, 5]
    left = C.decontamination(spark, docs, sf).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str(r) for r in rows if r[1] != leak)


def test_every_language_is_learned(spark):
    rows = [(k * 10 + i, f"word{k} " * 5, f"l{k:03}") for k in range(210) for i in range(9)]
    model = languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 2, 420)
    assert len(model.langs) == 210

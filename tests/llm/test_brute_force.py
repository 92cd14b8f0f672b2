"""Operators and pipeline stages against brute-force versions, and inputs that once broke them."""

import gzip
import re
import zlib
from pathlib import Path

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo
from test_operators import brute_components, brute_spans

from veritide.llm import decontaminate, fingerprints, near_dup, packing, quality, secrets, shared, url_filter, warc
from veritide.llm.shared import new_path, read, written

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators and stages use themselves.
CLASH = ("findings", "blob", "digest", "row", "score", "predicted", "_k0", "_text", "_want", "_before", "before", "copy", "key", "keep", "text_of", "leak", "rest", "rep", "n", "bucket", "_id", "_h", "_n", "item_id")


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents").select(*C.COLUMNS)


def clashing(df):
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


def files(path):
    return sorted(p for p in Path(path.removeprefix("file://")).rglob("*.warc.gz"))


def test_warc_members(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", ("y" if i % 3 else "x") * 4000 + str(i % 3)) for i in range(30)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_warc(pages.coalesce(1), path)
    (one,) = files(path)
    raw = one.read_bytes()
    assert not list(one.parent.glob("_temporary*"))
    whole = gzip.decompress(raw)  # any gzip reader takes the archive as it is
    assert whole.count(b"WARC/1.1\r\n") == 30 and whole.count(b"WARC-Profile: ") == whole.count(b"WARC-Type: revisit") == 27
    # With broken payloads in all responses, only what decodes a response's payload can fail.
    at, broken, lengths = 0, bytearray(raw), []
    while at < len(raw):
        n = int.from_bytes(raw[at + 16 : at + 20], "little")
        member = raw[at : at + n]
        lengths.append((n, int.from_bytes(raw[at + 20 : at + 24], "little") == len(gzip.decompress(member))))
        if b"WARC-Type: response" in gzip.decompress(member):
            broken[at + n - 8 : at + n - 4] = b"\0\0\0\0"  # the payload's check sum
        at += n
    assert len(lengths) == 30 and all(ok for _, ok in lengths)
    one.write_bytes(broken)
    (one.parent / f".{one.name}.crc").unlink(missing_ok=True)
    rows = warc.read_warc(spark, path)
    assert rows.where("record_type = 'revisit'").count() == 27
    assert rows.where("target_uri IN ('http://h/4', 'http://h/5')").count() == 2
    assert warc.read_warc(spark, path, payload=False).count() == 30
    with pytest.raises(Exception, match="broken"):
        rows.where("record_type = 'response'").collect()
    # The reader keeps what it can't decide for Spark.
    reader = warc.WarcReader({"path": path})
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_length",), 1)])) == [EqualTo(("payload_length",), 1)]
    # Archives of other writers: one gzip stream, or no compression.
    for name, data in (("a.warc.gz", gzip.compress(whole)), ("b.warc", whole)):
        other = Path(new_path(spark, "warc").removeprefix("file://"))
        other.mkdir(parents=True)
        (other / name).write_bytes(data)
        got = warc.archived_pages(warc.read_warc(spark, f"file://{other}"))
        assert got.where("record_type = 'revisit'").count() == 27 and got.count() == 30


def test_leaks_equal_brute_force(spark, docs):
    bench = read(spark, SF, "benchmark")
    items = {r.item_id: decontaminate.normalise(r.text) for r in bench.collect()}
    rng = np.random.default_rng(4)
    texts = {r.doc_id: r.text for r in docs.where("char_length(text) < 1500").limit(40).collect()}
    for i, item in items.items():  # planted with none to too many edits
        edited = list(item)
        for _ in range(rng.integers(0, int(1.6 * decontaminate.RATE * len(item)))):
            at = rng.integers(0, len(edited))
            edited[at : at + 1] = [["z"], [], [edited[at], "q"]][rng.integers(0, 3)]
        texts[10_000 + i] = "words before it " + "".join(edited) + " and words after it"
    want = {}
    for k, item in items.items():
        pattern = decontaminate.Pattern(item)
        for i, t in texts.items():
            d, _ = pattern.search(decontaminate.normalise(t))
            if d <= int(decontaminate.RATE * len(item)):
                want[i, k] = d
    assert len(items) // 4 < len(want) and any(d > 3 for d in want.values())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block_bytes in (4 << 20, 700):  # one block, and many
        rows = decontaminate.leaks(df, bench, block_bytes=block_bytes, texts_bytes=20_000).collect()
        assert len(rows) == len(want) and {(r.doc_id, r.item_id): r.distance for r in rows} == want


def test_null_items_and_clashes(spark):
    item = "a long enough benchmark question about rivers and their sources"
    df = clashing(spark.createDataFrame([(1, item), (None, item), (2, "nothing of the kind")], "doc_id long, text string"))
    bench = spark.createDataFrame([(None, item), (3, item), (3, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()), key=str)
    assert got == sorted([(1, None), (1, 3), (None, None), (None, 3)], key=str)
    names = spark.createDataFrame([("q1", item)], "item_id string, text string")
    assert [r.item_id for r in decontaminate.leaks(df.where("doc_id = 1"), names).collect()] == ["q1"]


def test_near_duplicates_at_sf001(spark):
    import duckdb

    from veritide.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = con.execute(queries.ORACLES["op8_setsketch_near_dup"])
    names = [d[0] for d in got.description]
    want = sorted(map(str, got.fetchall()))
    rows = near_dup.op8_setsketch_near_dup(spark, sf).collect()
    assert sorted(str(tuple(r[c] for c in names)) for r in rows) == want


def test_ids(spark):
    named = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    for op in (near_dup.near_duplicates, fingerprints.fingerprint_documents):
        with pytest.raises(TypeError, match="doc_id must be an integer"):
            op(named)
    rows = packing.pack(named, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in rows} == {"a", "b"}
    ends = spark.createDataFrame([(-(2**63), "a b c d e f"), (2**63 - 1, "u v w x y z"), (0, "k l m")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_documents(ends).collect()}
    import hashlib

    assert got[-(2**63)] == hashlib.sha256(("a b c d e f"[:8] + "u v").encode()).hexdigest()


def brute_fingerprint(text):
    """(root, distinct leaves, leaves in order): the tree built by hand."""
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections = re.split(r"(?<=\n\n)(?!$)", text)
    out, leaves = [], []
    for section in sections:
        paragraphs = []
        for p in re.split(r"(?<=\n)(?!$)", section):
            own, at = [], 0
            while at < len(p):
                end = at
                while end < len(p) and end - at < 160 and p[end] not in ".!?\n":
                    end += 1
                while end < len(p) and p[end] in ".!?":
                    end += 1
                while at < end < len(p) and p[end] == " ":
                    end += 1
                end += end < len(p) and p[end] == "\n"
                own.append(p[at:end])
                at = end
            assert "".join(own) == p
            digests = [sha(x) for x in own]
            leaves += digests
            paragraphs.append(sha("p" + "".join(digests)))
        out.append(sha("s" + "".join(paragraphs)))
    return sha("r" + "".join(out)), leaves


def test_fingerprints_equal_brute_force(spark, docs):
    odd = ["", "a", "\n", "\n\n\n", "x.\n\ny!! z?\n", "w" * 500 + ". end", "...  a.  b", "é\n\n\n\nü. ", "no stop at all\nnext\n\nlast"]
    df = docs.unionByName(spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate(odd)], docs.schema))
    rows = {r.doc_id: r for r in fingerprints.fingerprint_documents(clashing(df)).collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    made = {i: brute_fingerprint(t) for i, t in texts.items()}
    order = sorted(texts, reverse=True)

    def likeness(a, b):
        if a[0] == b[0]:
            return 1.0
        x, y = ({d[: fingerprints.SHORT] for d in s[1]} for s in (a, b))
        return 2 * len(x & y) / max(1, len(x) + len(y))

    for i, after in zip(order, order[1:] + order[:1], strict=True):
        t, k = texts[i], len(texts[i]) // 3
        edited = brute_fingerprint(t[: len(t) - k] + texts[after][:k])
        assert rows[i].fingerprint[:64] == made[i][0] and rows[i].edited_fingerprint[:64] == edited[0], i
        assert re.findall(r",([0-9a-f]{10})", rows[i].fingerprint) == [d[:10] for d in made[i][1]]
        assert rows[i].near_next == pytest.approx(likeness(made[i], made[after]))
        assert rows[i].near_edited == pytest.approx(likeness(made[i], edited))
    # An edit is located by the leaves that the other text lacks.
    text = "One here. Two here.\nThree here.\n\nFour here. Five here."
    pair = spark.createDataFrame([(1, text, text.replace("Three", "Thrice"))], "i long, a string, b string")
    pair = fingerprints.with_fingerprint(fingerprints.with_fingerprint(pair, "a", "fa"), "b", "fb")
    assert pair.select(fingerprints.changed_leaves(F.col("fa"), F.col("fb")).alias("at")).first().at == [2]


def test_url_parts_and_held_out(spark):
    assert url_filter.parts("http://H0.net?x=0#y") == url_filter.Parts("http", "h0.net", "", "x=0", True)
    assert url_filter.parts("https://a.b/c//d.html#?e") == url_filter.Parts("https", "a.b", "/c//d.html", "", True)
    assert url_filter.parts("x/y?") == url_filter.Parts("", "x", "/y", "", False)
    urls = [f"http://h{i}.net?x={i}" for i in range(20)]
    assert set(url_filter.suffix_statistics(urls, np.ones(20), 0.5)) == {"net", "net/", ""}
    # Trained on four fifths of the URLs that rules judge, the trees agree with the rules on the rest.
    pages = read(spark, "/root/testdata/sf0.1", "pages")
    known = url_filter.judge(pages, model=url_filter.Trees()).where("rule IS NOT NULL").select("page_id", F.col("verdict"))
    known = known.join(pages, "page_id").select("url", (F.col("verdict") == "allow").cast("int").alias("label")).distinct().collect()
    fold = [zlib.crc32(r.url.encode()) % 5 == 0 for r in known]
    learn = [r for r, out in zip(known, fold, strict=True) if not out]
    held = [r for r, out in zip(known, fold, strict=True) if out]
    model = url_filter.fit([r.url for r in learn], np.array([float(r.label) for r in learn]))
    z = model.logit(np.array([url_filter.lexical(r.url, model.suffix) for r in held]))
    right = np.mean([(v >= 0) == bool(r.label) for v, r in zip(z, held, strict=True)])
    print(f"op6 held-out agreement {right:.3f} of {len(held)}")
    assert len(held) > 50 and right > 0.9


def test_stages_equal_brute_force(spark, docs):
    """Every stage on the rows that its predecessor kept, with foreign columns of clashing names beside."""
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    now = clashing(docs)
    machine = quality.train(docs, read(spark, SF, "labels"))
    one = quality.Rows(machine)
    accepted = {r.doc_id for r in docs.collect() if 1 / (1 + np.exp(-one.logit(r.text, r.n_chars))) >= 0.3}
    for name, stage in C.STAGES:
        out = written(stage(spark, now, SF), f"brute-{name}")
        if name == "packing":
            break
        assert out.columns == now.columns and out.where("findings <> 'own findings' OR _before <> 'own _before'").count() == 0
        got = {r.doc_id: r.text or "" for r in out.collect()}
        assert out.count() == len(got)
        if name == "quality":
            want = {i: t for i, t in rows.items() if i in accepted}
        elif name == "near_duplicates":
            want = {i: t for i, t in rows.items() if brute_roots[i][1] == i}
        elif name == "decontamination":
            bench = [decontaminate.normalise(r.text) for r in read(spark, SF, "benchmark").collect()]
            patterns = [(decontaminate.Pattern(b), int(decontaminate.RATE * len(b))) for b in bench if b]
            norm = {i: decontaminate.normalise(t) for i, t in rows.items()}
            want = {i: t for i, t in rows.items() if not any(p.search(norm[i])[0] <= e for p, e in patterns)}
        else:
            want = {}
            for i, t in rows.items():
                for _, a, b in reversed(brute_spans(t)):
                    assert not any(x in got[i] for x in (t[a:b],)), i
                want[i] = got[i] if secrets.scan(t) else t
        assert got == want, name
        rows, now = want, out
        brute_roots = brute_components(rows, 80) if name == "quality" else None
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}


def test_run_leaves_only_its_result(spark):
    before = shared.made()
    out = C.run(spark, SF)
    assert [p for p in shared.made() if p not in before] == [out._veritide_path] and out.count() > 100


def test_messy_quality_stage(spark):
    rows = [(1, None, None), (None, "", -3), (2, "plain words here. " * 30, None), (2, "plain words here. " * 30, None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert C.quality(spark, df, SF).columns == df.columns and C.quality(spark, df.limit(0), SF).count() == 0
    twice = df.unionByName(df)
    assert quality.score(twice, quality.train(twice, read(spark, SF, "labels"))).count() == 8

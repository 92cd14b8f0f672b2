"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.shared import exists, lean, new_path, read, ship, written
from veritide.llm.token_counts import normalised, representatives

#: The base rules in their order, then the rules added here.
_ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ACCESS = r"AKIA[A-Z0-9]+"
_HEX = r"[0-9a-f]+"
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_MORE = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    "hosted_token": (r"\b(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{36,}", "gh"),
    "chat_token": (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    "web_token": (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *_MORE)
RULES_VERSION = hashlib.sha256(repr((_ASSIGN, _ACCESS, _HEX, _MORE)).encode()).hexdigest()[:16]


def _either_case(pattern: str) -> str:
    """Letters of the keyword group in either case, as ASCII classes: IGNORECASE would also take other letters."""
    head, close, tail = pattern.partition(")")
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head) + close + tail


ASSIGN, ACCESS = re.compile(_either_case(_ASSIGN)), re.compile(_ACCESS)
# A failing run of hex digits is dropped whole, so only runs of 32 and more can matter.
HEX = re.compile(r"[0-9a-f]{32,}")
MORE = {k: (re.compile(p), must) for k, (p, must) in _MORE.items()}


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start, then kind in the order of KINDS; code points, end exclusive."""
    out = []
    low = text.lower() if not text.islower() else text
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, (rule, must) in MORE.items():
        if must in text:
            out += [(kind, *m.span()) for m in rule.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# What may stand between two lines of a key's body: white space, its escapes, quotes.
_GAP = r"(?:[\s\"'>|,]|\\[nrt])"
_END = r"-----END [A-Z ]*PRIVATE KEY-----"
_NEXT = re.compile(rf"{_END}|-----BEGIN ")
# Without END: header fields, long base64 runs, and lines that hold nothing but base64.
_BODY = re.compile(
    rf"(?:{_GAP}*+(?:[A-Z][A-Za-z]*-[A-Za-z-]+: [^\r\n\\]*|[A-Za-z0-9+/]{{20,}}+=*+|[A-Za-z0-9+/]++(?:==?(?![A-Za-z0-9])|(?=[ \t\"']*(?:[\r\n\\]|\Z)))))*+"
)


def key_end(text: str, at: int) -> int:
    """Where the private key ends whose BEGIN line ends at ``at``: after its END line, or after its base64 lines without one."""
    last = _NEXT.search(text, at)
    return last.end() if last and last[0].startswith("-----END") else _BODY.match(text, at).end()


def scan_whole(text: str) -> list[tuple[str, int, int]]:
    """``scan``, with private keys up to their ends, as they are to be replaced."""
    return [(k, s, key_end(text, e) if k == "private_key" else e) for k, s, e in scan(text)]


FINDINGS = "array<struct<kind:string,start:long,end:long>>"
LEDGER_SCHEMA = f"digest binary, findings {FINDINGS}"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


#: Name of the ledger's folder by the scan: that of whole keys changes with its own patterns too.
VERSIONS = {
    scan: RULES_VERSION,
    scan_whole: RULES_VERSION + "-" + hashlib.sha256((_NEXT.pattern + _BODY.pattern).encode()).hexdigest()[:8],
}


def read_ledger(spark: SparkSession, path: str, by=scan) -> DataFrame:
    """Scanned blobs of the present rule version, those without findings too; none where nothing is stored."""
    here = f"{path}/rules={VERSIONS[by]}"
    if not exists(spark, here):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(here)


def scan_blobs(keyed: DataFrame, rows: DataFrame, ledger: str, by=scan) -> DataFrame:
    """Scan the blobs of ``keyed`` (_id, _text, _digest) that the ledger lacks, append them, return the ledger's findings.

    rows: (_id, _digest) of ``keyed``.  The result is (digest, findings) of all blobs that have findings, as a
    table of its own: a join with it has two plain sides, so that Spark can split a blob that many rows share.
    """
    spark = keyed.sparkSession
    ship(spark)

    def run(batches):
        for b in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in by(t)] for t in b.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], ["digest", "findings"])

    todo = representatives(keyed, rows, read_ledger(spark, ledger, by)).select("_digest", "_text")
    todo.mapInArrow(lean(run), LEDGER_SCHEMA).write.mode("append").parquet(f"{ledger}/rules={VERSIONS[by]}")
    # A row repeated with its id was scanned for each of its copies, with the same findings.
    return written(read_ledger(spark, ledger, by).where(F.size("findings") > 0).dropDuplicates(["digest"]), "findings")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text")).withColumn(
        "_digest", F.unhex(F.sha2(F.col("_text"), 256))
    )


def scan_secrets(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, findings) of every row; each distinct content is scanned once for each rule version.

    ledger: folder that all executors share, kept between runs.  findings: array of (kind, start, end) in
    code points, end exclusive; empty for clean rows.  Null text is empty text and has no findings.  Null
    and repeated ids keep their rows; an empty table gives no rows; other columns are ignored.
    """
    keyed = keyed_texts(docs, id_col, text_col)
    rows = written(keyed.select("_id", "_digest"), "keys")
    found = scan_blobs(keyed, rows, ledger)
    joined = rows.join(found, F.col("_digest") == F.col("digest"), "left")
    none = F.array().cast(FINDINGS)
    return joined.select(
        F.col("_id").alias(id_col), F.col("_digest").alias("digest"), F.coalesce("findings", none).alias("findings")
    )


def redact(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in its text replaced by ``mark``; rows, columns and clean texts stay as they are.

    Overlapping findings are replaced as one; a private key is replaced with its body and END line.  A null
    text stays null; columns may have any names; repeated rows and null ids stay.  An empty table gives no rows.
    """
    keyed = keyed_texts(docs, id_col, text_col)
    found = scan_blobs(keyed, written(keyed.select("_id", "_digest"), "keys"), ledger, scan_whole)
    # The rows travel as one struct, so that no column of theirs can meet a name used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("blob", F.unhex(F.sha2(normalised(F.col("row")[text_col]), 256)))
    rows = rows.join(found, F.col("blob") == F.col("digest"), "left")
    dirty, whole = F.col("findings").isNotNull(), F.col("row")[text_col]

    def step(acc, f):
        text = whole
        begin, end = f["start"], f["end"]
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(begin - acc["at"], F.lit(0)).cast("int"))
        more = F.when(begin >= acc["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], more).alias("out"), F.greatest(acc["at"], end).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate(
        "findings", start, step, lambda acc: F.concat(acc["out"], F.substr(whole, (acc["at"] + 1).cast("int")))
    )
    new = F.when(dirty, clean).otherwise(whole)
    return rows.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def joined_spans(findings, kinds=None):
    of = findings if kinds is None else F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(
        F.transform(of, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all ``documents``, from an empty ledger in the shared folder."""
    found = scan_secrets(read(spark, sf_dir, "documents"), new_path(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined_spans(F.col("findings"), BASE), 256).alias("base_sha256"),
        joined_spans(F.col("findings")).alias("spans"),
    )

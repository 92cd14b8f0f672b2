"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance decides."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veritide.llm.shared import lean, read, ship, store_of, written

#: Errors allowed for each character of an item.
RATE = 0.06
#: Items shorter than this (normalised) must stand in the text unchanged and as whole words.
LEAST = 24
#: Scripts without spaces, each of whose characters begins and ends a word: Thai to Myanmar, Khmer, kana, Han.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalised(text: Column) -> Column:
    """Lower-cased letters and digits, with one space for everything between them."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.trim(F.lower(plain))


def normalise(text: str | None) -> str:
    """The same in Python, for tests."""
    kept = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text or "")
    return re.sub(" +", " ", kept).strip(" ").lower()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in ``budget`` + 1 pieces of nearly equal length, one of which ``budget`` errors leave whole."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _between(text: str, at: int) -> bool:
    """Whether a word may end and another begin before text[at]."""
    if at in (0, len(text)) or " " in text[at - 1 : at + 1]:
        return True
    return unicodedata.category(text[at])[0] != "M" and bool(_SPACELESS.search(text[at - 1 : at + 1]))


class Pattern:
    """Myers' algorithm for one item: the least edit distance of the item to any substring of a text."""

    def __init__(self, item: str):
        self.m = len(item)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(distance, end): the least distance, and where its first best substring ends."""
        full = (1 << self.m) - 1
        high = 1 << (self.m - 1)
        pv, mv, score = full, 0, self.m
        best, end = self.m, 0
        get = self.peq.get
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph <<= 1
            mh <<= 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
            if score < best:
                best, end = score, at
        return best, end


class Matcher:
    """All items of one block: an automaton of their pieces, and one pattern for each."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int = LEAST):
        import ahocorasick

        self.items = items
        self.short = [len(t) < least for _, t in items]
        self.budget = [0 if short else int(rate * len(t)) for (_, t), short in zip(items, self.short, strict=True)]
        self.patterns = [Pattern(t) for _, t in items]
        where: dict[str, list] = {}
        for k, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.budget[k]):
                where.setdefault(piece, []).append((k, offset))
        self.auto = ahocorasick.Automaton()
        for piece, places in where.items():
            self.auto.add_word(piece, (len(piece), places))
        if where:
            self.auto.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item within its budget somewhere in the text: (least distance, end of the passage)."""
        spans: dict[int, list] = {}
        found: dict[int, tuple[int, int]] = {}
        for last, (n, places) in self.auto.iter(text) if self.items else ():
            for k, offset in places:
                if self.short[k]:
                    if k not in found and _between(text, last + 1 - n) and _between(text, last + 1):
                        found[k] = (0, last + 1)
                    continue
                m, e = self.patterns[k].m, self.budget[k]
                begin = last + 1 - n - offset
                lo, hi = max(0, begin - e), min(len(text), begin + m + e)
                held = spans.setdefault(k, [])
                if held and lo <= held[-1][1] and lo >= held[-1][0]:
                    held[-1][1] = max(held[-1][1], hi)
                else:
                    held.append([lo, hi])
        for k, windows in spans.items():
            for lo, hi in windows:
                d, end = self.patterns[k].search(text[lo:hi])
                if d <= self.budget[k] and (k not in found or d < found[k][0]):
                    found[k] = (d, lo + end)
        return found


def blocks(path: str, block_bytes: int):
    """The items (id, text) of a written table in blocks of about ``block_bytes``; a worker holds one block at a time."""
    store, root = store_of(path)
    held, size = [], 0
    for b in ds.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=1024):
        for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
            held.append((i, t))
            size += len(t.encode())
            if size >= block_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


class Searcher:
    """Matches texts against all items of a table, block by block; one block's automaton stays for the next call."""

    def __init__(self, path: str, many: bool, rate: float, least: int, block_bytes: int):
        self.path, self.many, self.args, self.block_bytes = path, many, (rate, least), block_bytes
        self.one: tuple | None = None

    def _matchers(self):
        if self.one is not None:
            yield self.one
            return
        for items in blocks(self.path, self.block_bytes):
            made = items, Matcher(items, *self.args)
            if not self.many:
                self.one = made
            yield made

    def rows(self, texts: list[str]) -> list[tuple]:
        """(position of the text, item id, distance, budget, end of the passage) of all matches, by position."""
        out = []
        for items, matcher in self._matchers():
            for at, t in enumerate(texts):
                for k, (d, end) in matcher.matches(t).items():
                    out.append((at, items[k][0], d, matcher.budget[k], end))
        return sorted(out, key=lambda r: (r[0], r[1] is None, r[1]))


def leaks(
    docs: DataFrame,
    bench: DataFrame,
    rate: float = RATE,
    block_bytes: int = 4 << 20,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts_bytes: int = 32 << 20,
) -> DataFrame:
    """(id, item_id, distance, budget, passage_end): every item within its error budget of a passage of a text.

    An item of n normalised characters may differ by floor(rate * n) edits; one shorter than ``least`` by
    none, and it counts only as whole words.  passage_end counts characters of the normalised text.
    The items are a table in the shared folder that each task reads; none of them pass through the driver.
    Texts are read once: of a benchmark over ``block_bytes`` each task matches its texts, in groups of about
    ``texts_bytes``, against one block after the other.  Null and empty texts leak nothing, nor do null and
    empty items; null ids of both sides are kept as they are, repeated rows of ``docs`` each give their rows,
    equal items with equal ids count once; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    items = bench.select(F.col("item_id").alias("i"), normalised(F.col("text")).alias("t")).where(F.length("t") > 0)
    items = written(items.distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    path, many = items._veritide_path, size >= block_bytes
    item_type = to_arrow_type(items.schema["i"].dataType)
    names = [id_col, "item_id", "distance", "budget", "passage_end"]

    def run(batches):
        search = Searcher(path, many, rate, least, block_bytes)
        held, n = [], 0

        def found():
            rows = search.rows([t for b in held for t in b.column(1).to_pylist()])
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            ids = pa.chunked_array([b.column(0) for b in held]).take(pa.array(cols[0], pa.int64())).combine_chunks()
            kinds = [item_type, pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names)

        for b in batches:
            held.append(b)
            n += b.nbytes
            if not many or n >= texts_bytes:
                yield found()
                held, n = [], 0
        if held:
            yield found()

    schema = f"`{id_col}` {kind}, item_id {item_kind}, distance int, budget int, passage_end long"
    return texts.mapInArrow(lean(run), schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (doc_id, item_id) leaks of ``benchmark`` in ``documents``."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

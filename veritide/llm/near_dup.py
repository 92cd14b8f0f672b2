"""Near-duplicates on word shingles by SetSketch registers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.components import components
from veritide.llm.shared import drop, integer_ids, lean, read, ship, written


@dataclass(frozen=True)
class Sketch:
    """SetSketch of bands * rows registers over minima of rate a, spaced exponentially by base.

    With 5 rows and 38 bands a pair at similarity 0.80 shares no band once in four million, at 0.85 once in
    five thousand million.  By Chernoff's bound a pair at the threshold (0.80 or 0.85) is estimated ``slack``
    below it less than once in a thousand million, so the estimate loses no more than the bands may.
    """

    rows: int = 5
    bands: int = 38
    base: float = 1.02
    rate: float = 20.0
    top: int = 32_000
    width: int = 5
    pairs_up_to: int = 64  # members of a bucket whose pairs are listed; larger buckets are compared in blocks
    block_rows: int = 512
    block_elements: int = 1_000_000
    slack: float = 0.21  # pairs estimated this far below the threshold are not verified

    @property
    def m(self) -> int:
        return self.rows * self.bands


DEFAULT = Sketch()
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words than ``width`` the whole sequence is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * _MUL + h[i : len(words) - k + 1 + i]
    return np.unique(_mixed(out))


def _families(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(0, 2**31, m, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, m, np.uint32)


def registers(hashes: np.ndarray, s: Sketch = DEFAULT) -> np.ndarray:
    """int16 registers: floor(1 - log_base(minimum)), truncated to 0..top; the larger of two merges their sets."""
    mul, add = _families(s.m)
    low = np.full(s.m, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024] * mul[:, None]
        part += add[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / s.rate
    return np.clip(np.floor(1 - np.log(h) / np.log(s.base)), 0, s.top).astype(np.int16)


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Similarity of each pair by maximum likelihood, jointly from the registers and the known set sizes."""
    more, less = (ka > kb).sum(1), (ka < kb).sum(1)
    same = ka.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, 1, 201)[:, None] * np.minimum(u / v, v / u)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base), 1e-12, 1)

    up, down = p(u - v * grid), p(v - u * grid)
    like = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(grid, like.argmax(0)[None], 0)[0]


def sketches(docs: DataFrame, id_col: str, text_col: str, s: Sketch) -> DataFrame:
    """(_id, n, set_hash, regs) of every row; an empty set has no registers."""

    def run(batches):
        for b in batches:
            n, key, regs = [], [], []
            for t in b.column(1).to_pylist():
                x = shingles(t, s.width)
                n.append(len(x))
                key.append(xxhash.xxh3_128_digest(x.tobytes()))
                regs.append(registers(x, s).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())],
                ["_id", "n", "set_hash", "regs"],
            )

    two = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return two.mapInArrow(lean(run), "_id long, n long, set_hash binary, regs binary")


def buckets(reps: DataFrame, s: Sketch) -> DataFrame:
    """(bucket, rep, n, lead, lead_n) of the bands that at least two representatives share; lead is the smallest.

    The leads are a table of their own, so that Spark can split the rows of a bucket that many share.
    """
    size = 2 * s.rows
    band = F.expr(f"transform(sequence(0, {s.bands - 1}), i -> xxhash64(i, substring(regs, i * {size} + 1, {size})))")
    rows = reps.select(F.explode(band).alias("bucket"), "rep", "n")
    lead = rows.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("l"), F.max("rep").alias("hi")).where("l.rep <> hi")
    lead = written(lead.select(F.col("bucket").alias("_b"), F.col("l.rep").alias("lead"), F.col("l.n").alias("lead_n")), "leads")
    out = written(rows.join(lead, F.col("bucket") == F.col("_b")).drop("_b"), "buckets")
    drop(lead)
    return out


def _alike_sizes(percent: int):
    return (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))


def star_pairs(member: DataFrame, percent: int) -> DataFrame:
    """(a, b): each bucket's smallest member with every other member."""
    both = member.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"), F.col("lead_n").alias("na"), F.col("n").alias("nb"))
    return both.where(_alike_sizes(percent)).select("a", "b").distinct()


def cross_pairs(member: DataFrame, percent: int) -> DataFrame:
    """(a, b): all members of one bucket that lie in different components."""
    x = member.select("bucket", F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = member.select(F.col("bucket").alias("_b"), F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    both = x.join(y, (F.col("bucket") == F.col("_b")) & (F.col("ca") < F.col("cb")) & _alike_sizes(percent))
    return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def block_links(member: DataFrame, sets: DataFrame, percent: int, rows: int, elements: int) -> DataFrame:
    """Links across components inside large buckets, as edges (u, v); one for each two components and block.

    member: (bucket, rep, comp, k, e), the last two the members and set elements of the bucket.  Members
    are dealt by hash to blocks of about ``rows`` members and ``elements`` set elements, and each two blocks are compared in one task on their full sets: work is spread over block pairs,
    and only links leave it.
    """
    dealt = member.withColumn("nb", F.ceil(F.greatest(F.col("k") / rows, F.col("e") / elements)).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = dealt.select("bucket", "rep", "comp", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("t"))
    dealt = dealt.select("bucket", "rep", "comp", "blk", F.least("blk", "t").alias("lo"), F.greatest("blk", "t").alias("hi"))
    dealt = dealt.join(sets, "rep")

    def run(table):
        rep, comp, blk = (table.column(c).to_numpy() for c in ("rep", "comp", "blk"))
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
        n = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), n)
        _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count[which] > 1  # the others are in no intersection
        owner, which = owner[shared], np.unique(which[shared], return_inverse=True)[1]
        both = np.zeros((len(parts), len(parts)), np.float32)
        order = np.argsort(which, kind="stable")
        owner, which = owner[order], which[order]
        for at in range(0, (which[-1] + 1) if len(which) else 0, 4096):
            a, b = np.searchsorted(which, (at, at + 4096))
            block = np.zeros((len(parts), 4096), np.float32)
            block[owner[a:b], which[a:b] - at] = 1
            both += block @ block.T
        union = n[:, None] + n[None, :] - both
        i, j = np.nonzero((100 * both >= percent * union) & (comp[:, None] < comp[None, :]))
        if blk.min() != blk.max():
            other = blk[i] != blk[j]
            i, j = i[other], j[other]
        _, one = np.unique(np.stack([comp[i], comp[j]]), axis=1, return_index=True)
        return pa.table({"u": rep[i[one]], "v": rep[j[one]]}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(run, "u long, v long")


def likely(pairs: DataFrame, reps: DataFrame, percent: int, s: Sketch) -> DataFrame:
    """The pairs whose estimated similarity is not clearly below the threshold."""
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                c = b.slice(at, 2048)
                ra, rb = (np.stack([np.frombuffer(x, np.int16) for x in c.column(i).to_pylist()]) for i in (4, 5))
                na, nb = (c.column(i).to_numpy().astype(float) for i in (2, 3))
                ok = estimate(ra, rb, na, nb, s.base) >= percent / 100 - s.slack
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1)], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on their full sets, as edges (u, v)."""
    side = lambda k: sets.select(F.col("rep").alias(k), F.col("elements").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(lean(run), "u long, v long")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, s: Sketch) -> DataFrame:
    """(rep, elements): the whole shingle sets of the wanted documents, made again from their texts."""

    def run(batches):
        for b in batches:
            sets = [shingles(t, s.width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["rep", "elements"])

    two = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    mine = two.join(wanted.select(F.col("rep").alias("_id")).distinct().hint("shuffle_hash"), "_id", "left_semi")
    return mine.mapInArrow(lean(run), "rep long, elements binary")


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    sketch: Sketch = DEFAULT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; links need 100 * intersection >= percent * union.

    Equal sets are one class; classes that share a band of registers are compared: first each bucket's
    members with its smallest member, then, in buckets whose members still lie in different components,
    all members across components: as pairs in small buckets, in blocks in large ones.  Estimates drop
    listed pairs that are clearly below the threshold, full sets decide.
    Empty sets (null text too) link with nothing and form their own component.  Ids must be integers (else
    TypeError) and should be distinct; rows that repeat with their id get the same result, and a row with a
    null id gets the component of its class.  An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    integer_ids(docs, id_col)
    s = sketch
    base = written(sketches(docs, id_col, text_col, s), "sketches")
    reps = base.where("n > 0 AND _id IS NOT NULL").groupBy("set_hash", "n", "regs").agg(F.min("_id").alias("rep"))
    reps = written(reps, "classes")
    member = buckets(reps, s)
    wanted = written(member.select("rep").distinct(), "wanted")
    full = written(full_sets(docs, wanted, id_col, text_col, s), "sets")
    # Of rows that repeat with their id one is taken; else the sets stay a plain table, as ``buckets`` says of leads.
    again = not full.groupBy("rep").count().where("count > 1").isEmpty()
    sets = written(full.dropDuplicates(["rep"]), "one-set") if again else full
    regs = written(reps.join(wanted, "rep", "left_semi"), "registers")

    def linked(pairs, label):
        some = written(likely(pairs, regs, percent, s), f"{label}-likely")
        out = written(verified(some, sets, percent), f"{label}-links")
        drop(some)
        return out

    def split(stars):
        """The members of the buckets whose members lie in different components, with the bucket's size."""
        rows = member.join(stars.select(F.col("u").alias("rep"), F.col("v").alias("_root")), "rep", "left")
        rows = rows.select("bucket", "rep", "n", F.coalesce("_root", "rep").alias("comp"))
        size = rows.groupBy("bucket").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), F.sum("n").alias("e")
        )
        size = written(size.where("lo <> hi").select(F.col("bucket").alias("_b"), "k", "e"), "sizes")
        out = written(rows.join(size, F.col("bucket") == F.col("_b")).drop("_b"), "rest")
        drop(size)
        return out

    first = linked(star_pairs(member, percent), "first")
    stars = components(first)
    rest = split(stars)
    second = linked(cross_pairs(rest.where(F.col("k") <= s.pairs_up_to), percent), "second")
    large = block_links(rest.where(F.col("k") > s.pairs_up_to), sets, percent, s.block_rows, s.block_elements)
    more = written(large.unionByName(second), "links")
    last = components(stars.unionByName(more))
    drop(first, second, stars, rest, more, full, sets, regs, wanted, member)

    root = reps.join(last.select(F.col("u").alias("rep"), F.col("v").alias("_root")), "rep", "left")
    root = written(root.select(F.col("set_hash").alias("_key"), F.coalesce("_root", "rep").alias("_root")), "roots")
    drop(last, reps)
    # Both sides are plain tables, so that Spark can split the rows of a set that many share.
    out = base.select("_id", "n", "set_hash").join(root, F.col("set_hash") == F.col("_key"), "left")
    comp = F.coalesce("_root", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        comp.alias("component_id"),
        F.coalesce(F.col("_id") == comp, F.lit(False)).alias("kept"),
    )


def op8_setsketch_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)

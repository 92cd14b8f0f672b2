"""Harmonic packing of token sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm.shared import lean, read, ship
from veritide.llm.tokens import encoder

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int, classes: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``n`` tokens; class k has k pieces to a sequence.

    Pieces are cut to the largest capacity // k that fits, for k up to ``classes``; what is then left is
    shorter than that and keeps its length, in the class of the largest k whose share it fits.
    """
    out, small = [], capacity // classes
    while n > small:
        k = -(-capacity // min(n, capacity))
        if k > classes:
            break
        out.append((capacity // k, k))
        n -= capacity // k
    if n:
        out.append((n, capacity // n))
    return out


class Packer:
    """Fills the sequences of each class as pieces come; holds at most one open sequence for a class."""

    def __init__(self, capacity: int, classes: int, first: int):
        self.capacity, self.classes, self.next = capacity, classes, first
        self.open: dict[int, list] = {}

    def _sequence(self, pieces):
        at, seq = 0, self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, ids, total, seq, at
            at += n

    def add(self, doc, ids: bytes):
        total, start = len(ids) // 4, 0
        for n, k in cuts(total, self.capacity, self.classes):
            held = self.open.setdefault(k, [])
            held.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(held) == k:
                del self.open[k]
                yield from self._sequence(held)

    def close(self):
        """The pieces of unfinished sequences, end to end: full sequences, then powers of two, which need no padding."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        left = sum(len(p[2]) for p in rest) // 4
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            pieces, need = [], room
            while need:
                doc, start, ids, total = rest.pop(0)
                n = min(need, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.insert(0, (doc, start + n, ids[4 * n :], total))
                need -= n
            yield from self._sequence(pieces)
            left -= room


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    classes: int = 32,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document: its ids, and its place in a sequence of ``capacity`` ids.

    Length class k has exactly k pieces to a sequence.  Each task fills the sequences of its own part of
    the input, with no shuffle, and cuts freely so that nearly all classes fit exactly; what is left in a
    task's open sequences is joined to full sequences and powers of two.  ids: little-endian unsigned
    32-bit ids.  Null and empty texts are one end id.  Ids of any type stay as they are, null too; repeated
    rows are packed each for itself; an empty table gives no rows.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, "ids")
        end = int(end_id).to_bytes(4, "little")
        packer = Packer(capacity, classes, TaskContext.get().partitionId() << 40)
        kinds = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

        rows = []
        for b in batches:
            kinds[0] = b.column(0).type
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), enc.ids(texts), strict=True):
                rows.extend(packer.add(doc, ids + end))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield batch(rows)

    two = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return two.mapInArrow(lean(run, encodes=True), f"`{id_col}` {kind}, {SCHEMA}")


def digest_columns(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return digest_columns(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))

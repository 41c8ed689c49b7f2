"""Document fingerprints by Order MinHash.

Of all occurrence-numbered k-mers of a text (the third "ab" is another element
than the first), each of M hash ranges keeps the L with the least hashes; these
are put back into text order and hashed as a tuple.  Two texts share an entry
only if they share its k-mers in the same order, so entries tell edit distance
and not only common content.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions
from .kernels import Rolling, mix

K, ENTRIES, TUPLE = 8, 64, 2


class OrderMinHash:
    """Fingerprints of texts: ``entries`` 16-bit numbers, 0 where a hash range has no k-mer.

    ``entries`` is a power of two.  A text shorter than k is one k-mer of its own.
    """

    def __init__(self, k: int = K, entries: int = ENTRIES):
        self.k, self.entries, self.rolling = k, entries, Rolling(5)
        self.shift = np.uint64(64 - int(entries).bit_length() + 1)

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        out = np.zeros(self.entries, np.uint16)
        n = len(points)
        if not n:
            return out
        sums = self.rolling.sums((points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        k = min(self.k, n)
        h = mix((sums[k:] - sums[:-k]) * self.rolling.down[: n - k + 1])
        key = mix(h)
        ordered = np.sort(h)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):  # only k-mers that occur again have a number
            at = np.searchsorted(again, h)
            some = np.flatnonzero(again[np.minimum(at, len(again) - 1)] == h)
            by = np.argsort(h[some], kind="stable")
            same = np.concatenate(([False], h[some][by][1:] == h[some][by][:-1]))
            each = np.arange(len(some))
            number = np.empty(len(some), np.uint64)
            number[by] = each - np.maximum.accumulate(np.where(same, 0, each))
            key[some] = mix(h[some] + number * np.uint64(0xD1B54A32D192ED03))
        place, low = np.arange(len(key)), len(key) // self.entries
        if low > 24:  # the least of each range lie below a bound; should a range have too few there, all are sorted
            within = key & np.uint64((1 << int(self.shift)) - 1)
            few = np.flatnonzero(within < np.uint64(int(12 / low * (1 << int(self.shift)))))
            if (np.bincount((key[few] >> self.shift).astype(np.int64), minlength=self.entries) >= TUPLE).all():
                place = few
        place = place[np.argsort(key[place], kind="stable")]
        ranges = (key[place] >> self.shift).astype(np.int64)
        first = np.searchsorted(ranges, np.arange(self.entries))
        count = np.searchsorted(ranges, np.arange(self.entries), "right") - first
        one = np.flatnonzero(count == 1)
        two = np.flatnonzero(count >= 2)
        a, b = place[first[two]], place[first[two] + 1]
        left, right = h[np.minimum(a, b)], h[np.maximum(a, b)]
        out[two] = 1 + (mix(left * np.uint64(3) + mix(right)) >> np.uint64(40)) % np.uint64(65535)
        out[one] = 1 + (mix(h[place[first[one]]]) >> np.uint64(40)) % np.uint64(65535)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries among those that either text has; 1 for two empty texts."""
    used = (a > 0) | (b > 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def edited_text(text: str, following: str) -> str:
    """The last floor(n/4) code points give way to the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FIELDS = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of each text's edited form, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint
    (base64 of 64 16-bit entries), near_edited and near_next.  The next document
    is the next by ascending doc_id, after the last the first.  Rows are dealt by
    range of doc_id and read in order, one at a time; only the first and the last
    row of each range meet their neighbours in another, small step.

    Null text: empty; two empty texts are alike (1), and an empty one is unlike
    any other (0).  Null doc_id: before all others.  Equal doc_ids: by hash of
    text, then text; repeated rows follow each other.  One row: its own next.  No rows: no rows.
    Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "fingerprint")
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("text").asc()]
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # the sample that sets the ranges goes to the driver, so it must not hold texts; the hash splits an id of many rows
    ranged = whole.repartitionByRange(max(2, partitions(docs.sparkSession)), *order[:2]).sortWithinPartitions(*order).drop("hash")
    names = ["doc_id", "text", "part", "last", *[f.split()[0] for f in FIELDS.split(", ")]]

    def told(make: OrderMinHash, text: str, mark: np.ndarray, following: str, next_mark: np.ndarray) -> tuple:
        edited = edited_text(text, following)
        edited_mark = make(edited)
        return len(text), hashlib.sha256(edited.encode()).digest(), mark.tobytes(), edited_mark.tobytes(), likeness(mark, edited_mark), likeness(mark, next_mark)

    def batch(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        kinds = [of, pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, part, held, of = OrderMinHash(), TaskContext.get().partitionId(), None, None
        for b in batches:
            rows, of = [], b.schema.field("doc_id").type
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                t = t.as_py()
                mark = make(t)
                if held is None:
                    rows.append((i, t, part, False, *[None] * 6))  # the first row, for the range before
                else:
                    rows.append((held[0], None, part, None, *told(make, *held[1:], t, mark)))
                held = (i, t, mark)
            yield batch(rows, of)
        if held:
            yield batch([(held[0], held[1], part, True, *[None] * 6)], of)  # the last row needs the range behind

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = OrderMinHash()
        for b in batches:
            rows = [(i, None, 0, None, *told(make, t, make(t), f, make(f))) for i, t, f in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "following")], strict=True)]
            yield batch(rows, b.schema.field("doc_id").type)

    schema = f"doc_id {kind}, text string, part int, last boolean, {FIELDS}"
    made = ws.keep(ranged.mapInArrow(read, schema), "made")
    edges = made.filter("last is not null").select("doc_id", "text", "part", "last")
    firsts = edges.filter("not last").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    parts = edges.filter("last").select("part").distinct()  # two rows for each range at most
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.partitionBy(F.lit(0)).orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next_part"))
    lasts = edges.filter("last").join(after, "part").join(firsts, "next_part").select("doc_id", "text", "following")
    text = lambda c: F.translate(F.base64(c), "\r\n", "")
    out = made.filter("last is null").unionByName(lasts.mapInArrow(join, schema))
    return out.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), text(F.col("fingerprint")).alias("fingerprint"), text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def decode_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint16)

"""Substring dedup by seed and extend on winnowed anchors.

Seeds: of every run of ANCHORS consecutive 8-word hashes the least is an anchor
(winnowing), so two equal 20-word windows always share one.  Documents meet on
anchors that stand in more than one place.  Extend: all occurrences of an
anchor meet with the words around them and are extended a word at a time, to
the left and to the right; occurrences whose words agree stay together, and when
left and right make up 20 words only the first of those still together isn't a
repeat.  So no pair of occurrences is looked at.  What a document repeats joins
to maximal repeats, and all but the first occurrence goes.

An anchor with more than HOT occurrences (boilerplate) would bring them all to one
task.  Its occurrences are extended where they stand, to each 20-word window
around it, and equal windows meet under 96 bits of hash: one entry for each chunk.

Documents are dealt once into chunks by hash.  A chunk asks about its anchors
(and then their occurrences) in packed arrays, one row for each bucket of
hashes, and gets packed answers back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .kernels import Rolling, Text, mix, slices, window_starts

LENGTH, SEED = 20, 8
#: Bytes of text in a chunk on average, if the number of chunks isn't given.
CHUNK_BYTES = 32 << 20
#: Occurrences of an anchor that meet in one task at most.
HOT = 128
ANCHORS = LENGTH - SEED + 1


def sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over every run of ``size`` values, by doubling."""
    width = 1
    while 2 * width <= size:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def extend(anchor: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of occurrences of anchors, in order of place, the windows that start earlier too.

    ``left`` and ``right`` have the words beside the anchor, nearest first, 0 beyond
    the document.  Bit k of an answer stands for the window that starts k words
    before the anchor.  Classes of occurrences that agree are refined word by
    word on either side; a window's class is its left class with its right one.
    """
    steps = left.shape[1]
    _, words = np.unique(np.concatenate((left, right), 1), return_inverse=True)
    words = words.reshape(len(anchor), 2 * steps)
    _, whole = np.unique(anchor, return_inverse=True)

    def classes(words: np.ndarray, there: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = [(whole, np.ones(len(anchor), bool))]
        for k in range(steps):
            _, agree = np.unique((out[-1][0] << 32) | words[:, k], return_inverse=True)
            out.append((agree, out[-1][1] & there[:, k]))
        return out

    before, after = classes(words[:, :steps], left > 0), classes(words[:, steps:], right > 0)
    out = np.zeros(len(anchor), np.uint32)
    for k in range(steps + 1):
        (a, inside), (b, still) = before[k], after[steps - k]
        some = np.flatnonzero(inside & still)
        _, first = np.unique((a[some] << 32) | b[some], return_index=True)
        again = np.ones(len(some), bool)
        again[first] = False
        out[some[again]] |= np.uint32(1 << k)
    return out


class Chunk:
    """The documents of a chunk in order of doc_id (null first), then hash, then text."""

    def __init__(self, docs: pa.Table, length: int, seed: int):
        self.length, self.seed, self.a, self.b = length, seed, Rolling(6), Rolling(60)
        docs = docs.select(["doc_id", "place", "text"]).sort_by([("doc_id", "ascending"), ("place", "ascending"), ("text", "ascending")])
        nulls = docs.column("doc_id").is_null()
        self.docs = pa.concat_tables([docs.filter(nulls), docs.filter(pc.invert(nulls))]).combine_chunks()
        ids = self.docs.column("doc_id").fill_null(np.iinfo(np.int64).min)
        self.ids = ids.to_numpy().astype(np.int64)

    def each(self):
        """By slices with windows: first document, first words, hashes of words, windows (first word, row, anchor value), first words of anchors."""
        at = 0
        for whole in self.docs.to_batches():
            for s in slices(whole, "text"):
                x = Text(s.column("text"))
                start, end, first = x.words()
                i, row = window_starts(first, self.length)
                if len(i):
                    word = self.a.words(x.bytes, start, end)
                    n, steps = len(word) - self.seed + 1, self.length - self.seed
                    grams = self.a.between(self.a.sums(word), np.arange(n), np.arange(n) + self.seed)
                    least = sliding(grams, steps + 1, np.minimum)
                    valid = np.zeros(len(least), bool)
                    valid[i] = True
                    pad = np.zeros(steps, np.uint64)
                    top = sliding(np.concatenate((pad, np.where(valid, least, 0), pad)), steps + 1, np.maximum)
                    p = np.flatnonzero(top == grams)  # a gram that is least in some window
                    # the least of several hashes are small, so they are mixed again before they are dealt into ranges
                    yield at, first, word, (i, row, mix(least[i])), (p, mix(grams[p]))
                at += s.num_rows

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and how often each stands here (65535: at least)."""
        found = [np.unique(value, return_counts=True) for *_, (_, value) in self.each()]
        values = np.concatenate([v for v, _ in found]) if found else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
        distinct, where = np.unique(values, return_inverse=True)
        return distinct, np.minimum(np.bincount(where, counts, len(distinct)), 65535).astype(np.uint16)

    def occurrences(self, keys: np.ndarray, hot: np.ndarray, words: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Occurrences of the repeated anchors ``keys`` that aren't hot, by anchor (value, row, place, and if asked the words on the left and on the right, 48 bits each), and windows of hot ones (hash pair, row, place), by place."""
        seeds, windows = [], []
        steps = self.length - self.seed
        for at, first, word, (i, row, least), (p, value) in self.each():
            k = _among(keys, value)
            p, value = (x[(k >= 0) & ~hot[k]] for x in (p, value))
            where = np.searchsorted(first, p, "right") - 1
            parts = [value, at + where, p - first[where]]
            if words:
                bits = np.concatenate((np.maximum(word >> np.uint64(16), np.uint64(1)), np.zeros(1, np.uint64))).view(np.uint16).reshape(-1, 4)[:, :3]  # 0 for none
                beside = np.empty((len(p), 2 * steps, 3), np.uint16)
                for k in range(steps):
                    before, after = p - 1 - k, p + self.seed + k
                    beside[:, k] = bits[np.where(before >= first[where], before, len(word))]
                    beside[:, steps + k] = bits[np.where(after < first[where + 1], after, len(word))]
                parts.append(beside)
            seeds.append(parts)
            k = _among(keys, least)
            of = np.flatnonzero((k >= 0) & hot[k])
            if len(of):
                i, row = i[of], row[of]
                other = self.b.sums(mix(word + np.uint64(7)))
                windows.append([self.a.between(self.a.sums(word), i, i + self.length), self.b.between(other, i, i + self.length), at + row, i - first[row]])
        none = [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros((0, 2 * steps, 3), np.uint16)][: 4 if words else 3]
        order = np.argsort(np.concatenate([none[0], *[x[0] for x in seeds]]), kind="stable")
        out = []
        for k, x in enumerate(none):
            out.append(np.concatenate([x, *[part[k] for part in seeds]])[order])
            for part in seeds:
                part[k] = None  # held once
        none = [*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2]
        return out, [np.concatenate(x) for x in zip(none, *windows, strict=True)]


def _among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The index of each value in the sorted keys, -1 for others."""
    k = np.searchsorted(keys, values)
    if not len(keys):
        return np.full(len(values), -1)
    return np.where(keys[np.minimum(k, len(keys) - 1)] == values, k, -1)


def first_of_each(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct windows, by hash: the index of the first occurrence; and for each window its distinct one."""
    order = np.lexsort((np.arange(len(h)), h2, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits of a hash, so that buckets of a sorted array are slices of it."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _ask(kind: int, chunk: int, keys: np.ndarray, n: int, packed: dict[str, np.ndarray]) -> pa.Table:
    """One row for each bucket with keys (sorted); every packed array is cut the same way."""
    cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    some = np.flatnonzero(np.diff(cuts))
    rows = {"kind": pa.array(np.full(len(some), kind, np.int32)), "chunk": pa.array(np.full(len(some), chunk, np.int32)), "bucket": pa.array(some.astype(np.int32))}
    for name, values in packed.items():
        rows[name] = pa.array([values[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary())
    return pa.table(rows)


def _answer(asked: pa.Table, keys: list[np.ndarray], told: list[np.ndarray]) -> pa.Table:
    packed = {"keys": pa.array([x.tobytes() for x in keys], pa.binary()), "told": pa.array([x.tobytes() for x in told], pa.binary())}
    return pa.table({c: asked.column(c) for c in ("kind", "chunk", "bucket")} | packed)


def _told(replies: pa.Table, kind: int) -> tuple[bytes, bytes]:
    """The packed keys and answers of all buckets, put together in order of hash."""
    t = replies.filter(pc.equal(replies.column("kind"), kind)).sort_by("bucket")
    return b"".join(t.column("keys").to_pylist()), b"".join(t.column("told").to_pylist())


ANCHOR, SEEDS, WINDOWS = 0, 1, 2
COUNTED = "kind int, chunk int, bucket int, keys binary, counts binary"
ASKED = "kind int, chunk int, bucket int, keys binary, words binary, ids binary, row binary, place binary"
REPLY = "kind int, chunk int, bucket int, keys binary, told binary"


def _arrays(asked: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in asked.column(column).to_pylist()]


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, seed: int = SEED, chunks: int | None = None) -> DataFrame:
    """Documents without words inside repeats of ``length`` or more words.

    ``docs`` has doc_id (integer) and text; words are ``[^\\x20\\x09-\\x0D]+``,
    unchanged.  A window is ``length`` consecutive words of a document.  A word
    goes if a window over it has an equal one that starts earlier (smaller
    doc_id, or same document, earlier start).  Returns doc_id, n_words,
    n_removed, kept (the other words joined by one space), and repeats: the
    maximal removed runs as array<struct<start, end>> of word numbers.
    ``length`` exceeds ``seed`` by at most 31.

    ``chunks``: how many parts documents are dealt into, by default the number
    of shuffle partitions, or more so that a part has ``CHUNK_BYTES`` of text; one
    chunk's text is in a Python worker's memory, whatever the size of the input
    and however often a doc_id is repeated.

    Null or empty text: no words, nothing removed.  Null doc_id: before all
    others.  Rows with the same doc_id: by hash of text, then text, so repeated
    rows lose what the first keeps.  No rows: no rows.  Other columns are
    ignored.  Long texts are read whole; a text of one repeated word keeps its
    first window.
    """
    spark = docs.sparkSession
    n = chunks or max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES))
    buckets = n  # a chunk sends a row to each at most
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33)  # 31 bits, and chunks are ranges of them: the order of rows with one doc_id is that of place in any number of chunks
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("place", place).withColumn("chunk", F.shiftright(F.col("place") * n, 31).cast("int"))

    def ask_anchors(docs: pa.Table) -> pa.Table:
        keys, counts = Chunk(docs, length, seed).anchors()
        return _ask(ANCHOR, docs.column("chunk")[0].as_py(), keys, buckets, {"keys": keys, "counts": counts})

    def meet_anchors(asked: pa.Table) -> pa.Table:
        keys, counts = _arrays(asked, "keys", np.uint64), _arrays(asked, "counts", np.uint16)
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts))[which]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        many = [t > 1 for t in np.split(total, cuts)]
        return _answer(asked, [k[m] for k, m in zip(keys, many, strict=True)], [t[m] > HOT for t, m in zip(np.split(total, cuts), many, strict=True)])

    def known(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, hot = _told(replies, ANCHOR)
        return np.frombuffer(keys, np.uint64), np.append(np.frombuffer(hot, bool), False)

    def ask_occurrences(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _ask(SEEDS, 0, np.zeros(0, np.uint64), buckets, dict.fromkeys(ASK, np.zeros(0, np.uint64)))
        chunk, number = Chunk(docs, length, seed), docs.column("chunk")[0].as_py()
        (value, row, at, words), (h, h2, of, start) = chunk.occurrences(*known(replies), True)
        seeds = _ask(SEEDS, number, value, buckets, {"keys": value, "words": words, "ids": chunk.ids[row], "row": row.astype(np.int32), "place": at.astype(np.int32)})
        f, _ = first_of_each(h, h2)
        windows = _ask(WINDOWS, number, h[f], buckets, {"keys": h[f], "words": (h2[f] >> np.uint64(32)).astype(np.uint32), "ids": chunk.ids[of[f]], "row": of[f].astype(np.int32), "place": start[f].astype(np.int32)})
        return pa.concat_tables([seeds, windows])

    def meet_occurrences(asked: pa.Table) -> pa.Table:
        keys, ids, row, at = [_arrays(asked, c, kind) for c, kind in (("keys", np.uint64), ("ids", np.int64), ("row", np.int32), ("place", np.int32))]
        sizes = [len(k) for k in keys]
        who = np.repeat(asked.column("chunk").to_numpy(), sizes)
        h, ids, row, at = [np.concatenate(x) for x in (keys, ids, row, at)]
        if asked.column("kind")[0].as_py() == SEEDS:
            order = np.lexsort((at, row, who, ids))
            words = np.zeros((len(h), 2 * (length - seed), 4), np.uint16)
            words[:, :, :3] = np.concatenate([x.reshape(-1, 2 * (length - seed), 3) for x in _arrays(asked, "words", np.uint16)])
            words = words.view(np.uint64)[:, :, 0]
            told = np.zeros(len(h), np.uint32)
            told[order] = extend(h[order], words[order, : length - seed], words[order, length - seed :])
        else:
            h2 = np.concatenate(_arrays(asked, "words", np.uint32))
            order = np.lexsort((at, row, who, ids, h2, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            told = np.ones(len(h), bool)
            told[order[new]] = False
        return _answer(asked, [k[:0] for k in keys], np.split(told, np.cumsum(sizes)[:-1]))

    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(docs, length, seed)
        (_, row, at), (h, h2, of, start) = chunk.occurrences(*known(replies), False)
        bits = np.frombuffer(_told(replies, SEEDS)[1], np.uint32)
        goes = [(row[hit], at[hit] - k) for k in range(length - seed + 1) if len(hit := np.flatnonzero(bits >> np.uint32(k) & np.uint32(1)))]
        if len(h):
            f, which = first_of_each(h, h2)
            again = np.ones(len(h), bool)  # all but the first here, and that one if it stands earlier elsewhere
            again[f] = np.frombuffer(_told(replies, WINDOWS)[1], bool)
            goes.append((of[again], start[again]))
        key = np.unique(np.concatenate([(r << 32) | p for r, p in goes])) if goes else np.zeros(0, np.int64)
        row, place = key >> 32, key & 0xFFFFFFFF
        cuts = np.searchsorted(row, np.arange(len(chunk.ids) + 1))
        out = []
        for i, text in enumerate(chunk.docs.column("text").to_pylist()):
            words = (text or "").encode().split()
            runs = []
            p = place[cuts[i] : cuts[i + 1]]
            if len(p):
                ends = np.flatnonzero(np.diff(p) > length)  # windows that neither overlap nor touch
                for a, b in zip(p[np.concatenate(([0], ends + 1))].tolist(), p[np.concatenate((ends, [len(p) - 1]))].tolist(), strict=True):
                    runs.append({"start": a, "end": b + length})
            kept, at = [], 0
            for r in runs:
                kept += words[at : r["start"]]
                at = r["end"]
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), runs))
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), spans]
        return pa.Table.from_arrays([chunk.docs.column("doc_id"), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], names=["doc_id", "n_words", "n_removed", "kept", "repeats"])

    counted = dealt.groupBy("chunk").applyInArrow(ask_anchors, COUNTED)
    anchors = counted.groupBy("bucket").applyInArrow(meet_anchors, REPLY)
    asked = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(ask_occurrences, ASKED)
    extended = asked.groupBy("kind", "bucket").applyInArrow(meet_occurrences, REPLY)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, repeats array<struct<start:int,end:int>>"
    return dealt.groupBy("chunk").cogroup(anchors.unionByName(extended).groupBy("chunk")).applyInArrow(finish, schema)


ASK = ("keys", "words", "ids", "row", "place")

"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal sets of word shingles are one node.  Nodes that share a
band of MinHash values are candidates; candidates are compared MinHash value by
MinHash value and dropped as soon as the posterior probability that their
similarity reaches the threshold falls below a tolerance.  What is left forms
candidate groups; inside a group pairs are pruned in the same way, and those that
are left are verified on the shingle sets themselves.  Pairs are counted where
they are compared: what leaves a task is a row for each node, never a row for
each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, components, partitions, runs
from .kernels import Rolling, Text, mix, slices, window_starts

#: Words in a shingle; least similarity; posterior probability below which a pair is dropped.
SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
#: MinHash values of a document (one-permutation hashing) and values in a band: at
#: similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 40 = 7e-10.
BINS, BAND = 160, 4
#: Documents of at most FEW values meet on single values too: with 4 or 5 shared shingles
#: and one more, all in one band, no band is shared with 40 ** -4 or 40 ** -5. From 6 shared
#: ones on that is under 3e-10; on single values it is under 160 ** -4 = 2e-9, times the
#: chance, a fifth, that the one more is least of its range.
FEW = 6
#: Documents that share a band and are all compared at most; beyond that (a passage that many
#: documents hold fills bands of its own) they are compared only where they share a second band.
#: A pair at similarity 0.8 shares one band only with probability 40 * 0.41 * 0.59 ** 39 = 2e-8.
HOT_BAND = 4096
#: MinHash values compared before the posterior is looked up again.
STEP = 32
#: Members of a block, as signatures and as sets, and shingles of a block on average; two blocks meet in one go.
BLOCK, SET_BLOCK, SET_SHINGLES = 512, 256, 1 << 20


class Shingles:
    """Shingle sets of documents as sorted 48-bit hashes, all rows of a slice in one array."""

    def __init__(self, size: int):
        self.size, self.rolling = size, Rolling(2)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row (rising) and hash (rising within a row) of every distinct shingle."""
        x = Text(column)
        start, end, first = x.words()
        sums = self.rolling.sums(self.rolling.words(x.bytes, start, end))
        i, row = window_starts(first, self.size)
        h = self.rolling.between(sums, i, i + self.size)
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < self.size))  # all words of a short document are its only shingle
        h = np.concatenate((h, self.rolling.between(sums, first[short], first[short + 1])))
        both = np.unique((np.concatenate((row, short)).astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
        return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)


def set_keys(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set: sums over its members."""
    out = []
    for salt in (1, 2):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt << 50)), dtype=np.uint64)))
        at = np.searchsorted(row, np.arange(n + 1))
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash: of each of BINS ranges of the hash the least value, as 16 bits; 0 where there is none."""
    out = np.zeros((n, BINS), np.uint16)
    at = ((h * np.uint64(BINS)) >> np.uint64(48)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
    out[row[first], at[first]] = 1 + mix(h[first]) % np.uint64(65535)
    return out


def needed(threshold: float, tolerance: float) -> np.ndarray:
    """For n compared values the least number of equal ones that keeps a pair.

    Under a uniform prior the posterior after m equal values of n is
    Beta(m + 1, n - m + 1), which exceeds the threshold with the probability
    that a binomial of n + 1 draws has at most m successes.
    """
    out = np.zeros(BINS + 1, np.int64)
    for n in range(1, BINS + 1):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def plausible(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of signatures may reach the threshold, by incremental comparison; b has as many rows, or one."""
    live = np.arange(len(a))
    n = m = np.zeros(len(a), np.int64)
    for at in range(0, BINS, STEP):
        x, y = a[live, at : at + STEP], b[live if len(b) == len(a) else slice(None), at : at + STEP]
        used = (x | y) > 0
        n, m = n + used.sum(1), m + ((x == y) & used).sum(1)
        keep = m >= least[n]
        live, n, m = live[keep], n[keep], m[keep]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each, by symmetric links."""
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(root)).min(1, initial=len(root)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def sketch_documents(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n (distinct shingles), k1, k2 (the set's hash) and sig of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(size)
        for b in batches:
            for s in slices(b, "text"):
                row, h = make(s.column("text"))
                k1, k2 = set_keys(row, h, s.num_rows)
                sig = [x.tobytes() for x in signatures(row, h, s.num_rows)]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(np.bincount(row, minlength=s.num_rows)), pa.array(k1), pa.array(k2), pa.array(sig, pa.binary())], names=["doc_id", "n", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sketch, "doc_id bigint, n bigint, k1 bigint, k2 bigint, sig binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = _matrix(b.column("sig"))
        bands = sig.reshape(b.num_rows, BINS // BAND, BAND).copy().view(np.uint64)[:, :, 0]
        row, k = np.nonzero(bands)
        key = mix(bands[row, k] ^ mix(k.astype(np.uint64) + np.uint64(1)))
        few = np.flatnonzero((sig > 0).sum(1) <= FEW)
        i, k = np.nonzero(sig[few])
        key = np.concatenate((key, mix(sig[few][i, k].astype(np.uint64) ^ mix(k.astype(np.uint64) + np.uint64(1 + BINS)))))
        row = np.concatenate((row, few[i]))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("rep").take(pa.array(row))], names=["band", "rep"])


def _prune(least: np.ndarray):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = plausible(_matrix(b.column("sig")), _matrix(b.column("sig_b")), least)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return prune


def _across(least: np.ndarray):
    """Plausible pairs of different components in a bucket, one for each join of two."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["band", "lo", "hi"]):
            t = t.combine_chunks()
            rep, block = t.column("rep").to_numpy(), t.column("block").to_numpy()
            _, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
            sig = _matrix(t.column("sig").combine_chunks())
            one = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
            found = []
            for i in range(len(rep)):
                j = np.flatnonzero((comp[i + 1 :] != comp[i]) & (one | (block[i + 1 :] != block[i]))) + i + 1
                if len(j):
                    for k in j[plausible(sig[j], sig[i : i + 1], least)]:
                        if comp[k] != comp[i]:
                            comp[comp == comp[k]] = comp[i]
                            found.append((rep[i], rep[k]))
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return across


def _blocks(df: DataFrame, key: str, n: Column) -> DataFrame:
    """Deal the members of a group into ``n`` blocks, and each member to every pair of blocks that has its own; rows of a pair meet, sorted, in one task.

    The pairs of a group go to tasks in turn, so a large group fills all of them alike.
    """
    tasks = partitions(df.sparkSession)
    dealt = df.withColumn("nb", F.greatest(n, F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")}).drop("with")
    lo = F.col("lo").cast("bigint")
    pair = lo * F.col("nb") - F.floor(lo * (lo - 1) / 2) + F.col("hi") - lo
    dealt = dealt.withColumn("task", F.pmod(F.pmod(F.xxhash64(key), F.lit(tasks)) + pair, F.lit(tasks)).cast("int"))
    return dealt.repartitionById(tasks, "task").drop("task").sortWithinPartitions(key, "lo", "hi")


def _plausible_pairs(sig: np.ndarray, rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs of signatures may reach the threshold, as a matrix; ``rows`` is a matrix of the pairs asked about."""
    a, b = np.nonzero(np.triu(rows, 1))
    out = np.zeros(rows.shape, bool)
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        keep = plausible(sig[x], sig[y], least)
        out[x[keep], y[keep]] = True
    return out | out.T


def _verify(threshold: float, least: np.ndarray):
    """For every member of a pair of blocks its verified links and the least member it is joined to."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["comp", "lo", "hi"]):
            t = t.combine_chunks().sort_by([("rep", "ascending"), ("k1", "ascending")])
            rep, k1 = t.column("rep").to_numpy(), t.column("k1").to_numpy()
            new = np.ones(len(rep), bool)
            new[1:] = (rep[1:] != rep[:-1]) | (k1[1:] != k1[:-1])
            t = t.filter(pa.array(new))
            rep, block, copies = rep[new], t.column("block").to_numpy(), t.column("copies").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            asked = np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-6
            if t.column("lo")[0].as_py() != t.column("hi")[0].as_py():
                asked &= block[:, None] != block[None, :]
            asked = _plausible_pairs(signatures(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), len(sets)), asked, least)
            some = np.flatnonzero(asked.any(1))  # the others have no pair left to verify
            linked = np.zeros(asked.shape, bool)
            if len(some):
                common = _common([sets[i] for i in some])
                union = sizes[some][:, None] + sizes[some][None, :] - common
                linked[np.ix_(some, some)] = common >= threshold * union - 1e-6
                linked &= asked
            links = linked @ copies
            root = _roots(linked)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64)), pa.array(rep[root]), t.column("nb").combine_chunks()], names=["rep", "links", "root", "nb"])

    return verify


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all these sets."""
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # a shingle of one member is in no intersection
    member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[count[which] > 1]
    which = number[which[count[which] > 1]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(which, kind="stable")
    member, which = member[order], which[order]
    for at in range(0, int(which[-1]) + 1 if len(which) else 0, 4096):
        a, b = np.searchsorted(which, [at, at + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[member[a:b], which[a:b] - at] = 1
        common += x @ x.T
    return common


def join_near(docs: DataFrame, *, shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links and copy_of of every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of
    ``shingle``-word shingles (words between ASCII white space, unchanged) is at
    least ``threshold``.  n_links counts the other documents a document is
    linked with, copies among them; class_id is the least doc_id of those
    reachable over links; copy_of the least doc_id with an equal set.  A linked
    pair is lost with the probability, 7e-10 at most, that it shares no band (nor,
    of documents of few shingles, a single value), with about ``tolerance`` that it
    is pruned, and with 2e-8 at most if its one shared band has over HOT_BAND documents.

    A document of fewer words has one shingle, all its words; null, empty and
    blank texts have none, link with nothing and are classes of their own.  Null
    doc_id: class_id and copy_of null, 0 links.  Repeated rows are copies of each
    other; rows that share a doc_id but no text count as one document.  Ties
    can't matter: ids are compared, not rows.  No rows: no rows.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ngramjoin")
    least = needed(threshold, tolerance)
    sketch = ws.keep(sketch_documents(docs, shingle), "sketch")
    reps = sketch.filter("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = ws.keep(reps, "reps")

    bands = reps.select("rep", "sig").mapInArrow(_bands, "band bigint, rep bigint")
    leaders = bands.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    shared = ws.keep(bands.join(leaders, "band"), "bands")
    of = reps.select("rep", "n", "sig")
    stars = shared.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(of.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    stars = stars.join(of.withColumnRenamed("rep", "a"), "a").filter((F.least("n", "n_b") >= threshold * F.greatest("n", "n_b") - 1e-6))
    edges = ws.keep(stars.select("a", "b", "sig", "sig_b").mapInArrow(_prune(least), "a bigint, b bigint"), "stars")
    groups = components(ws, edges, "stars")

    placed = shared.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "members", F.coalesce("comp", "rep").alias("comp"))
    split = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("members").alias("members")).filter("lo < hi and members > 2").select("band")
    left = placed.join(split, "band")
    pairs = left.filter(F.col("members") > HOT_BAND).join(shared.select("rep", F.col("band").alias("other")), "rep").filter("other <> band")
    pairs = pairs.select(F.xxhash64(F.least("band", "other"), F.greatest("band", "other")).alias("band"), "rep", "comp").distinct()
    per = pairs.groupBy("band").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "members")
    left = left.filter(F.col("members") <= HOT_BAND).unionByName(pairs.join(per, "band"))
    left = left.join(of.select("rep", "sig"), "rep")
    left = _blocks(left, "band", F.ceil(F.col("members") / BLOCK)).select("band", "lo", "hi", "rep", "block", "comp", "sig")
    more = ws.keep(left.mapInArrow(_across(least), "a bigint, b bigint"), "across")
    if more.limit(1).count():
        groups = components(ws, edges.union(more), "across")

    nodes = groups.join(reps.select(F.col("rep").alias("node"), "n", "copies", "k1", "k2"), "node")
    sizes = nodes.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") / SET_SHINGLES)).alias("blocks"))
    nodes = nodes.join(sizes, "comp").select(F.col("node").alias("doc_id"), "comp", "blocks", "copies", "k1", "k2")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(nodes, "doc_id")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(shingle)
        for b in batches:
            for s in slices(b, "text"):
                row, h = make(s.column("text"))
                k1, k2 = set_keys(row, h, s.num_rows)
                own = (k1 == s.column("k1").to_numpy()) & (k2 == s.column("k2").to_numpy())
                at = np.searchsorted(row, np.arange(s.num_rows + 1))
                sets = pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[s.column(c) for c in ("doc_id", "comp", "blocks", "copies", "k1")], sets], names=["rep", "comp", "blocks", "copies", "k1", "shingles"]).filter(pa.array(own))

    sets = texts.mapInArrow(shingles, "rep bigint, comp bigint, blocks bigint, copies bigint, k1 bigint, shingles binary")
    dealt = _blocks(sets, "comp", F.col("blocks"))
    verified = ws.keep(dealt.mapInArrow(_verify(threshold, least), "rep bigint, links bigint, root bigint, nb int"), "verified")
    whole = verified.filter("nb = 1").select("rep", F.col("root").alias("class_id"))
    parts = verified.filter("nb > 1 and rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if parts.limit(1).count():
        whole = whole.unionByName(components(ws, parts, "parts").select(F.col("node").alias("rep"), F.col("comp").alias("class_id")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = whole.groupBy("rep").agg(F.min("class_id").alias("class_id"))
    found = reps.select("k1", "k2", "n", "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left")
    found = found.select("k1", "k2", "n", "rep", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = sketch.select("doc_id", "n", *[F.when(F.col("doc_id").isNotNull(), F.col(k)).alias(k) for k in ("k1", "k2")]).join(found, ["k1", "k2", "n"], "left")
    return named.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("rep", "doc_id").alias("copy_of"))


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id (of equal ids, the least text with words).

    All texts without words (null, empty, blank) are one class here.  Rows with a
    null doc_id stay, and all columns, whatever their names.
    """
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), blank.alias("blank"))
    classes = join_near(docs.filter(~blank | F.col("doc_id").isNull()), **how).filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("kept")).distinct()
    first = rows.filter("blank").agg(F.min("id").alias("kept"))  # one row
    kept = rows.filter("not blank").join(classes, F.col("id").cast("bigint") == F.col("kept"), "left_semi")
    kept = kept.unionByName(rows.filter("blank").join(F.broadcast(first), F.col("id") == F.col("kept"), "left_semi"))
    kept = kept.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("blank", "row.text"))).filter("number = 1")
    return kept.select("row.*").unionByName(rows.filter("id is null").select("row.*"))

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Rolling, Text, mix, slices

#: Everything in ASCII that is neither letter nor digit stands between words.
BETWEEN = bytes(c for c in range(128) if not chr(c).isalnum())
#: Hashed features, and labelled rows that a model is fitted on at most.
BITS, MAX_ROWS = 22, 20_000
#: Documents of one labelled id that a model is fitted on at most.
MOST_COPIES = 4
#: Bytes of a word's start that stand for its stem.
STEMS = (4, 6)


#: Rates and sparsity for cross-validation to choose from. On the training fold of sf0.1 the
#: log loss of the defaults (alpha 0.5, l1 5) is 222, the least 211 (1, 8), the greatest 877 (1, 1).
CHOICES = tuple({"alpha": alpha, "l1": l1} for alpha in (0.1, 0.5, 1.0, 2.0) for l1 in (1.0, 2.0, 5.0, 8.0))


class Model(NamedTuple):
    """Features with a weight, their weights, the bias, and the clean and toxic examples that it was fitted on."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    clean: int
    toxic: int

    @property
    def usable(self) -> bool:
        """Examples of one kind only, or none, tell nothing apart."""
        return self.clean > 0 and self.toxic > 0


class Features:
    """Hashed features of documents: words, their stems, pairs of neighbours and pairs with one word between."""

    def __init__(self, bits: int):
        self.rolling, self.shift = Rolling(4), np.uint64(64 - bits)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every occurrence."""
        x = Text(pc.utf8_lower(column))
        start, end, first = x.words(BETWEEN)
        sums = self.rolling.sums(self.rolling.table[x.bytes])
        word = self.rolling.between(sums, start, end)
        row = np.repeat(np.arange(len(x)), np.diff(first))
        values, rows = [word], [row]
        for k, size in enumerate(STEMS, 1):
            long = end - start > size
            values.append(mix(self.rolling.between(sums, start[long], start[long] + size) + np.uint64(k)))
            rows.append(row[long])
        for k, gap in enumerate((1, 2), 11):
            same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
            left, right = word[: len(same)][same], word[gap:][same] if len(same) else word[:0]
            values.append(mix(left * np.uint64(3) + right + np.uint64(k)))
            rows.append(row[: len(same)][same])
        return np.concatenate(rows), (np.concatenate(values) >> self.shift).astype(np.int64)


def by_document(rows: np.ndarray, features: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """Distinct features of each of ``n`` documents."""
    both = np.unique((rows.astype(np.int64) << bits) | features)
    return np.split(both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(1, n)))


def fit_ftrl(examples: list[tuple[np.ndarray, int]], *, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0, epochs: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal with a rate per coordinate: features with a weight, the weights, the bias.

    A document's features count once each; l1 keeps the weight of a feature
    at zero until the sum of its gradients exceeds it.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = bias = 0.0
    for _ in range(epochs):
        for f, y in examples:
            zf, nf = z[f], n[f]
            live = np.abs(zf) > l1
            w = np.where(live, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            root = np.sqrt(nf + g * g)
            z[f] = zf + g - (root - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
            step = (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha
            bz, bn = bz + g - step * bias, bn + g * g
            bias = -bz / ((beta + np.sqrt(bn)) / alpha)
    at = np.flatnonzero(np.abs(z) > l1)
    w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return at, w.astype(np.float32), float(bias)


def chosen(examples: list[tuple[np.ndarray, int]], fold: np.ndarray, choices: tuple[dict, ...], **how) -> dict:
    """Of ``choices`` the one with the least log loss on examples that its model was not fitted on, over all folds."""
    losses = []
    for choice in choices:
        loss = 0.0
        for k in np.unique(fold).tolist():
            at, w, bias = fit_ftrl([examples[i] for i in np.flatnonzero(fold != k)], **how | choice)
            for i in np.flatnonzero(fold == k):
                f, y = examples[i]
                total = bias + float(w[np.isin(at, f, assume_unique=True)].sum())
                loss += float(np.logaddexp(0, -total if y else total))
        losses.append(loss)
    return choices[int(np.argmin(losses))]


def held_out(doc_id: Column) -> Column:
    """The fold kept out of training: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, max_rows: int = MAX_ROWS, choices: tuple[dict, ...] = (), folds: int = 3, **how) -> Model:
    """A model from the labelled documents outside the held-out fold.

    At most ``max_rows`` labelled ids, those with the least hash of doc_id, and of
    an id the MOST_COPIES documents with the least hash of text, go to one task,
    which fits the model; what comes to the driver is the weights, at most
    2 ** bits and few because of l1.  Ids labelled twice count as toxic if any
    label says so; null labels and ids are left out; documents repeated under an
    id are examples of their own.  Without labelled documents the model says
    0.5 of everything; it is not usable then, nor without examples of both kinds.

    ``choices`` (such as CHOICES) are settings of fit_ftrl to choose from, by
    cross-validation over ``folds`` parts of these examples, by hash of doc_id.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    examples = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_rows small rows
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))  # limited before the shuffle too
    examples = examples.withColumn("copy", copy).filter(F.col("copy") <= MOST_COPIES)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, rows = Features(bits), []
        for b in batches:
            for s in slices(b, "text"):
                of = by_document(*make(s.column("text")), s.num_rows, bits)
                rows += [(h, i, f.astype(np.int32), y) for h, i, f, y in zip(s.column("h").to_pylist(), s.column("doc_id").to_pylist(), of, s.column("y").to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        examples, setting = [(f, y) for _, _, f, y in rows], {"bits": bits, **how}
        if choices and rows:
            setting |= chosen(examples, np.array([h % folds for h, *_ in rows]), choices, **setting)
        at, w, bias = fit_ftrl(examples, **setting)
        toxic = sum(y for *_, y in rows)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2, -3], pa.int64()), pa.array([*w.astype(float).tolist(), bias, len(rows) - toxic, toxic], pa.float64())], names=["feature", "weight"])

    told = examples.select("doc_id", "text", "y", F.xxhash64("doc_id").alias("h")).repartition(1).mapInArrow(fit, "feature bigint, weight double").toPandas().sort_values("feature")
    at, w = told["feature"].to_numpy(), told["weight"].to_numpy()
    toxic, clean, bias = w[:3].tolist() if len(w) else (0.0, 0.0, 0.0)
    return Model(at[3:], w[3:].astype(np.float32), bias, int(clean), int(toxic))


def score_toxicity(docs: DataFrame, model: Model, *, bits: int = BITS) -> DataFrame:
    """``docs`` with score: the model's probability that a document is toxic, from its whole text alone.

    Null or empty text: the model's bias.  Ids, sources, languages, ties and
    repeated rows don't matter to a score; no rows: no rows; a column named
    score is replaced.  No shuffle.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model[:3])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        weights, used = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool)
        weights[at], used[at] = w, True
        make = Features(bits)
        for b in batches:
            out = []
            for s in slices(b, "text"):
                rows, features = make(s.column("text"))
                hit = used[features]
                both = np.unique((rows[hit].astype(np.int64) << bits) | features[hit])
                total = bias + np.bincount(both >> bits, weights[both & ((1 << bits) - 1)].astype(float), s.num_rows)
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*b.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, score double")


#: Documents with at least this score are rejected.
REJECT = 0.3

"""Benchmark decontamination: one Aho-Corasick automaton, one scan, offsets into the original text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .kernels import Rolling, window_starts

# A-Z become a-z; digits, letters and all bytes from 0x80 on are inside words, other ASCII between them.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes of benchmark text in one automaton, which takes some 60 times that in a worker.
AUTOMATON_BYTES = 4 << 20


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def item_windows(items: list[tuple], size: int) -> dict[str, dict]:
    """Windows of ``size`` words (all words of a shorter item), a blank around each word, and the ids of their items: in plain words what the scanner finds."""
    out: dict[str, dict] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            out.setdefault(f" {b' '.join(words[i : i + size]).decode()} ", {})[item] = None
    return out


class Windows:
    """The distinct runs of ``size`` word numbers that start at some places of ``body``, found by hash and then compared number by number."""

    def __init__(self, body: np.ndarray, start: np.ndarray, line: np.ndarray, size: int):
        self.body, self.size = body, size
        for seed in range(7, 99):  # until no two different runs share a hash
            self.rolling = Rolling(seed)
            h = self._hash(body, start)
            order = np.lexsort((line, h))
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            lead = start[order[new]]
            if self._equal(body, start[order], lead[np.cumsum(new) - 1]).all():
                break
        self.hashes, self.lead = h[order[new]], lead.astype(np.int32)
        self.first, self.lines = np.append(np.flatnonzero(new), len(h)).astype(np.int32), line[order].astype(np.int32)

    def _hash(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.rolling.between(self.rolling.sums(words.astype(np.uint64)), at, at + self.size)

    def _equal(self, words: np.ndarray, at: np.ndarray, lead: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for k in range(self.size):
            out &= words[at + k] == self.body[lead + k]
        return out

    def find(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those places ``at`` of ``words`` where a run starts, and the lines that hold these runs."""
        h = self._hash(words, at)
        k = np.searchsorted(self.hashes, h)
        k[k == len(self.hashes)] = 0
        hit = (self.hashes[k] == h) & self._equal(words, at, self.lead[k])
        lines = [self.lines[self.first[x] : self.first[x + 1]] for x in np.unique(k[hit]).tolist()]
        return at[hit], np.concatenate(lines) if lines else np.zeros(0, np.int64)


class Scanner:
    """One automaton over pieces of the items, and the windows that decide.

    An item is cut into pieces of half a window, so that every window holds a
    whole piece, and the first half of each piece is in the automaton.  Where it
    occurs, the windows around it are looked up.  Equal items are one line of
    word numbers.
    """

    def __init__(self, items: list[tuple], size: int):
        self.size, self.piece, self.numbers = size, (size + 1) // 2, {}
        key = (self.piece + 1) // 2
        lines: dict[tuple[int, ...], dict] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for item, text in items:
            if words := normal_words(text):
                line = tuple([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words])
                if line not in lines:
                    for piece in [words[i : i + key] for i in range(0, len(words) - self.piece + 1, self.piece)] if len(words) >= size else [words]:
                        self.found.add_word(_spaced(piece))
                lines.setdefault(line, {})[item] = None
        self.items = [list(ids) for ids in lines.values()]
        if lines:
            self.found.make_automaton()
        sizes = np.array([len(x) for x in lines], np.int64)
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        body = np.fromiter((x for line in lines for x in line), np.int32, int(first[-1]))
        self.windows = {n: Windows(body, first[:-1][sizes == n], np.flatnonzero(sizes == n), n) for n in set(sizes[sizes < size].tolist())}
        if (sizes >= size).any():
            start, line = window_starts(first, size)
            self.windows[size] = Windows(body, start, line, size)

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Words of the text, the hit runs of words [first, end), merged, and the ids found."""
        return self.scan(text)[:3]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set, bool]:
        """The same, and whether a window of full size occurs."""
        words = normal_words(text)
        if not words or not self.windows:
            return len(words), [], set(), False
        line = _spaced(words)
        pieces = [(end + 1 - length, end) for end, length in self.found.iter(line)]
        if not pieces:
            return len(words), [], set(), False
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        starts, ends = (np.unique(np.searchsorted(spaces, x)) for x in zip(*pieces, strict=True))
        numbers = np.array([self.numbers.get(w, 0) for w in words], np.int32)
        runs, lines, whole = [], [np.zeros(0, np.int64)], False
        for size, windows in self.windows.items():
            if size < self.size:
                at = ends[ends >= size] - size
            else:  # every window around a piece
                at = np.unique((starts[:, None] + np.arange(self.piece - size, 1)).ravel())
            at, found = windows.find(numbers, at[(at >= 0) & (at <= len(words) - size)])
            runs += [(a, a + size) for a in at.tolist()]
            lines.append(found)
            whole |= size == self.size and len(at) > 0
        return len(words), merged(runs), {x for k in np.unique(np.concatenate(lines)).tolist() for x in self.items[k]}, whole


def _spaced(words: list[bytes]) -> str:
    return " " + b" ".join(words).decode() + " "


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans [start, end) of runs of words in the text as it was given."""
    at = [m.span() for m in re.finditer(WORD, text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _parts(item, text: str | None, most: int, window: int) -> Iterator[tuple]:
    """An item whole, or cut into parts of ``most`` bytes (4 windows at least) that share all but a word of a window."""
    if len((text or "").encode()) <= most:
        yield item, text
        return
    words, at = normal_words(text), 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (size < most or end < at + 4 * window):
            size += len(words[end]) + 1
            end += 1
        yield item, b" ".join(words[at:end]).decode()
        if end == len(words):
            return
        at = end - window + 1


def _groups(benchmark: DataFrame, most: int, window: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in groups that fit one automaton; one empty group if there are none.  The driver holds one row and two groups at most."""
    group, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        for item, text in _parts(*row, most, window):
            more = len((text or "").encode())
            if group and size + more > most:
                yield group
                group, size = [], 0
            group.append((item, text))
            size += more
    yield group


FOUND, FOUND_TYPES = ("n_words", "n_hit", "hits", "items", "whole_window"), "n_words bigint, n_hit bigint, hits array<struct<start:int,end:int>>, items array<string>, whole_window boolean"
HITS = "h1 bigint, h2 bigint, runs array<int>, items array<string>, whole boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hits (spans of hit words in the original text), items (sorted ids found) and whole_window.

    A document word is hit inside any occurrence of ``window`` consecutive words
    of an item, or of all words of a shorter item; whole_window says whether a
    full window occurs.  One automaton holds the benchmark, every document is
    scanned once, and nothing is shuffled.

    A benchmark of more than ``automaton_bytes`` of text is cut into groups of so
    much (an item too, its parts overlapping), since a worker holds one automaton
    at a time.  Texts are then scanned once for each group, what is
    kept of a scan is the runs of words that hit, under a 128-bit hash of the text, and the
    runs of all groups join their documents in the end.

    Null or empty text, or one without words: 0 words, no hits.  Null items have
    no words and are never found; an id given twice is found once; equal items
    are found together; ids are compared as strings and null ids are not
    reported.  Empty benchmark: no hits.  No documents: no rows.  Columns of
    ``docs`` with the added names are replaced.
    """
    docs = docs.drop(*FOUND)
    spark = docs.sparkSession
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [FOUND_TYPES])
    groups = _groups(benchmark, automaton_bytes, window)
    first, second = next(groups), next(groups, None)
    if second is None:
        shared = spark.sparkContext.broadcast({"items": first})  # at most automaton_bytes
        return docs.mapInArrow(_scan(shared, window, text), schema)
    ws, kept = Workspace(spark, "decontam"), []
    hashed = [F.xxhash64(F.lit(k), F.col(text)).alias(f"h{k}") for k in (1, 2)]
    for group in chain([first, second], groups):
        shared = spark.sparkContext.broadcast({"items": group})
        found = docs.select(*hashed, F.col(text).alias("text")).mapInArrow(_find(shared, window), HITS)
        kept.append(ws.keep(found.dropDuplicates(["h1", "h2"]), "hits"))
        shared.destroy()
    hits = reduce(DataFrame.unionByName, kept).groupBy("h1", "h2").agg(F.collect_list(F.struct("runs", "items", "whole")).alias("found"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *hashed)
    return whole.join(hits, ["h1", "h2"], "left").select("doc", "found").mapInArrow(_gather(text), schema)


def _told(texts: list, results: list[tuple]) -> list[pa.Array]:
    """The FOUND columns from the texts and (words, runs, ids, whole) of each."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    hits = [[{"start": a, "end": b} for a, b in original_spans(t, runs)] if runs else [] for t, (_, runs, _, _) in zip(texts, results, strict=True)]
    return [
        pa.array([n for n, _, _, _ in results], pa.int64()),
        pa.array([sum(b - a for a, b in runs) for _, runs, _, _ in results], pa.int64()),
        pa.array(hits, span),
        pa.array([sorted({str(x) for x in ids if x is not None}) for _, _, ids, _ in results], pa.list_(pa.string())),
        pa.array([whole for *_, whole in results], pa.bool_()),
    ]


def _scanner(shared, window: int) -> Scanner:
    held = shared.value  # one object in a worker, so what is made of it serves its other tasks too
    if "scanner" not in held:
        held["scanner"] = Scanner(held["items"], window)
    return held["scanner"]


def _scan(shared, window: int, text: str) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared, window)
        for b in batches:
            texts = b.column(text).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, *_told(texts, [scanner.scan(t) for t in texts])], names=[*b.schema.names, *FOUND])

    return scan


def _find(shared, window: int) -> Callable:
    """Rows for the texts with hits only."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared, window)
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                _, runs, ids, whole = scanner.scan(t)
                if runs:
                    at.append(i)
                    out.append(([x for run in runs for x in run], [str(x) for x in ids if x is not None], whole))
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate([pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(at, pa.int64())) for c in ("h1", "h2")], *columns], names=["h1", "h2", "runs", "items", "whole"])

    return find


def _gather(text: str) -> Callable:
    """The FOUND columns from the hits of all groups."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = pa.RecordBatch.from_struct_array(b.column("doc"))
            texts, results = doc.column(text).to_pylist(), []
            for t, found in zip(texts, b.column("found").to_pylist(), strict=True):
                runs = [run for f in found or [] for run in zip(f["runs"][::2], f["runs"][1::2], strict=True)]
                results.append((len(normal_words(t)), merged(runs), {x for f in found or [] for x in f["items"]}, any(f["whole"] for f in found or [])))
            yield pa.RecordBatch.from_arrays([*doc.columns, *_told(texts, results)], names=[*doc.schema.names, *FOUND])

    return gather


def contaminated() -> Column:
    """Hit words make up a twentieth of the document or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))

"""Secret scan: candidates by shape, false positives removed by a random forest.

The forest sees a candidate's length and classes of characters, how likely its
character transitions are in natural words, how much of it a dictionary covers,
the path (source) it comes from, and the words next to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Text, slices

# Characters of a candidate, words that name a secret, words that name something else, path words of samples.
INSIDE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."
NAMES = "password passwd pwd secret token apikey api_key key access auth authorization bearer credential credentials private client_secret aws pass signature session jwt".split()
OTHERS = "commit sha sha1 sha256 md5 checksum hash digest uuid guid version id revision example sample dummy placeholder changeme build etag integrity file image page isbn order".split()
SAMPLES = "test tests example examples doc docs sample samples fixture fixtures mock spec readme".split()
NOTHING = "required true false none null undefined string value default enabled disabled optional hidden empty missing expired invalid unknown primary foreign public private basic bearer password secret token username getpass() os.environ process.env config.get input() ******** xxxxxxxx changeme ...... str bytes Optional[str]".split()
WORDS = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use about after again air also another around back because been before"
    " below between both came come could each even every find first found from give good great hand have here high home house into just kind know large last left life light line little live long look made make many may men might more most"
    " mother move much must name need never next number often only other over own page part people place point read right same school set should show small some sound spell still study such take tell than that their them then there these they"
    " thing think this those thought three through time together turn under until very want water well went were what when where which while will with word work world would write year your"
).split()

# How issued keys start; words in names of secrets; what follows such a word up to the value (a sign, "is" or blanks); where an unquoted value ends before its blank.
PREFIX = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|sk-|xox[abprs]-|npm_|pypi-|eyJ)(?=.{8})")
STEMS = "password passwd passphrase pass pwd secret token key auth bearer credential private signature session jwt".split()
VALUE = re.compile(
    r"([A-Za-z0-9_.\-]{0,24})(?:[\"'`]?\]?[ \t]*(?::=|=>|===?|=|:)\s*(?:(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]+)?|[ \t]+is:?[ \t]+|([ \t]+))"
    r"(?:\"([^\"\n]{4,4000})\"|'([^'\n]{4,4000})'|`([^`\n]{4,4000})`|[\"'`]?([^\s\"'`]\S{3,}))"
)
CLOSING = {")": "(", "]": "[", "}": "{", ">": "<"}
STOP = re.compile(r"[&;,](?=[\w.\-\"']+[=:])|[\"'`](?=[,;)\]}>&]|$)|</")

#: Least length of a candidate without a name and with one; least score of a finding.
SHORTEST, LEAST, REPORT = 16, 4, 0.5
FEATURES = 18


def entropy(text: str) -> float:
    return -sum(c / len(text) * log2(c / len(text)) for c in Counter(text).values()) if text else 0.0


def transitions(words: list[str]) -> np.ndarray:
    """Log-probabilities of a character after another in words, over a-z and everything else."""
    counts = np.ones((27, 27))
    for w in words:
        codes = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in f" {w.lower()} "]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


class Describe:
    """Features of a candidate in its place."""

    def __init__(self, words: list[str]):
        self.table, self.words = transitions(words), sorted({w for w in words if len(w) > 2}, key=len, reverse=True)
        self.cover = re.compile("|".join(map(re.escape, self.words)))

    def __call__(self, found: str, name: str, before: str, after: str, path: str) -> list[float]:
        n, low = len(found), found.lower()
        codes = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in low]
        near = re.findall(r"[a-z_0-9]+", before.lower())[-4:] + re.findall(r"[a-z_0-9]+", after.lower())[:2]
        named = set(re.findall(r"[a-z_0-9]+", name.lower())) | {x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", name)}
        return [
            n,
            sum(c.isdigit() for c in found) / n,
            sum(c.isupper() for c in found) / n,
            sum(c.islower() for c in found) / n,
            entropy(found),
            len(set(low)) / n,
            float(self.table[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
            sum(len(m[0]) for m in self.cover.finditer(low)) / n,
            sum(c in "-/." for c in found) / n,
            float(bool(re.fullmatch(r"[0-9a-f]+", found)) or 2 * bool(re.fullmatch(r"[0-9.\-+]+", found))),
            float(any(x in NAMES or x.endswith(("password", "secret", "token")) for x in named)),
            float(sum(x in NAMES for x in near)),
            float(sum(x in OTHERS for x in near) + sum(x in OTHERS for x in named)),
            float(any(x in SAMPLES for x in re.findall(r"[a-z]+", path.lower()))),
            sum(not c.isalnum() and c not in "-/._" for c in found) / n,
            float(bool(PREFIX.match(found))),
            float(len(re.findall(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+", found))) / n,
            float(bool(re.fullmatch(r"[$%]?[{<(\[]+[\w. \-]+[})>\]]+s?|\$\w+|[\w.]+\(\)|(\W)\1+|[xX]+", found))),
        ]


def named_values(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of the values after words that name a secret, and their names, in order and apart."""
    low = text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text)
    last = 0
    for at, stem in sorted({(m, stem) for stem in STEMS for m in _places(low, stem)}, key=lambda x: (x[0], -len(x[1]))):
        if at < last or not (m := VALUE.match(text, at + len(stem))):
            continue
        group = next(g for g in (3, 4, 5, 6) if m[g] is not None)
        start, end = m.span(group)
        if group == 6:
            cut = STOP.search(text, start + 1, end)
            end = cut.start() if cut else end
            while end > start and (text[end - 1] in ".,;:\\\"'`" or text[end - 1] in CLOSING and CLOSING[text[end - 1]] not in text[start : end - 1]):
                end -= 1
        value, left = text[start:end], at
        while left > max(0, at - 40) and (text[left - 1].isascii() and text[left - 1].isalnum() or text[left - 1] in "_-."):
            left -= 1
        if len(value) < LEAST:
            continue
        # after a mere blank a word of prose is no value: one with a digit or sign beside a letter is, or a long one
        if m[2] and (m[1] not in ("", "s") or left < at or group == 6 and len(value) < SHORTEST and not re.search(r"[A-Za-z]\S*[0-9!@#$%^&*]|[0-9!@#$%^&*]\S*[A-Za-z]", value)):
            continue
        if group == 6 and not m[2] and any(x in value.lower() for x in STEMS) and re.search(r"\w[\"']?[:=]\S{4}", value) and VALUE.search(value):
            continue  # it names another value
        if group == 6 and m[2] and re.match(r"[\w.\-]+[\"']?(?:[:=]|=>)", value):
            continue
        last = end
        yield start, end, text[left:at] + text[at : at + len(stem)] + m[1]


def _places(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def candidates(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Spans [start, end) in the text and the name given to each: values after names of secrets, then from runs of candidate characters outside of them."""
    taken = list(named_values(text))
    yield from taken
    k = 0
    for a, b in runs:
        run = text[a:b]
        name, eq, value = run.partition("=")
        if eq and name and value.strip("="):
            start, found = a + len(name) + 1, value
        else:
            start, found, name = a, run, ""
        found = found.rstrip(".-_")
        end = start + len(found)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if len(found) >= SHORTEST and not (k < len(taken) and taken[k][0] < end):
            if not name:
                m = re.search(r"([A-Za-z_]+)[\"']?\s*[:=]\s*[\"']?$", text[max(0, start - 40) : start])
                name = m[1] if m else ""
            yield start, end, name


def labelled_findings(n: int = 400, seed: int = 9) -> list[tuple[str, str, str, str, str, int]]:
    """Labelled findings (found, name, before, after, path, label) for training where none are given.

    Drawn from rules: keys, tokens and passwords as issued, against commit
    hashes, checksums, identifiers, numbers, dates, paths and placeholders, code, and words of prose after the name of a secret.
    """
    draw = np.random.default_rng(seed)
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda chars, k: "".join(chars[i] for i in draw.integers(0, len(chars), k))
    words = lambda k, sep: sep.join(WORDS[i] for i in draw.integers(0, len(WORDS), k))
    chosen = lambda: words(1, "").capitalize() + text("0123456789", int(draw.integers(1, 5))) + str(draw.choice(["!", "@", "#", "$", "", "!!"])) + text(mixed, int(draw.integers(0, 4)))
    syllables = lambda k: "".join(text("bcdfghjklmnprstvwz", 1) + text("aeiou", 1) + text("nrstlmh", int(draw.integers(0, 2))) for _ in range(k))
    cased = lambda word: [word, word.capitalize(), word.upper()][int(draw.integers(0, 3))]
    other = lambda: str(draw.choice(["author", "keyboard", "monkey", "passenger", "tokenizer", "authority", ""]))
    spelt = lambda: words(2, str(draw.choice(["", "!", "&", "_", "#"]))).translate(str.maketrans(dict(zip("oeias", draw.choice(["0314$", "03i@s", "0e!45", "o31@5"]), strict=True)))) + str(draw.choice(["", "!", "1", "7", "&3"]))
    out = []
    for _ in range(n):
        name = str(draw.choice(["password", "token", "secret", "api_key", "key", "auth"]))
        before, after = words(4, " ") + " ", " " + words(3, " ")
        path = str(draw.choice(["src", "app/config", "src1", "deploy", "web"]))
        out += [
            (text(hexa, int(draw.integers(16, 41))), name, before + name + " ", after, path, 1),
            (text(mixed, int(draw.integers(20, 45))), name, before + name + " ", after, path, 1),
            (str(draw.choice(["AKIA", "ASIA"])) + text(upper, 16), "", before, after, path, 1),
            (str(draw.choice(["ghp_", "sk_live_", "xoxb-"])) + text(mixed, 36), "", before, after, path, 1),
            (text(hexa, 40), "", before + str(draw.choice(["commit", "sha1", "revision"])) + " ", after, path, 0),
            (text(hexa, 32), str(draw.choice(["md5", "checksum", "etag"])), before + "checksum ", after, path, 0),
            ("-".join(text(hexa, k) for k in (8, 4, 4, 4, 12)), str(draw.choice(["", "id", "uuid"])), before, after, path, 0),
            (text("0123456789", int(draw.integers(16, 20))), "", before + str(draw.choice(["", "order ", "isbn "])), after, path, 0),
            (words(4, str(draw.choice(["-", "_", "/"]))) + str(draw.integers(0, 99)), "", before, after, path, 0),
            ("/".join([words(1, ""), str(draw.integers(2000, 2030)), words(2, "-")]) + ".html", "file", before + "file ", after, path, 0),
            (str(draw.choice(["your_password_here_123", "changeme-changeme-1", "xxxxxxxxxxxxxxxxxxx0", "example_token_000000"])), name, before + "example " + name + " ", after, str(draw.choice(["docs", "test/fixtures"])), 0),
            (text(mixed, 24), name, before + "example sample " + name + " ", after, str(draw.choice(["docs/example", "tests"])), 0),
            (chosen(), name, before + name + " ", after, path, 1),
            (spelt(), name, before + name + " ", after, path, 1),
            (words(int(draw.integers(3, 5)), "") + str(draw.choice(["", "", "1", "!"])), name, before + name + " ", after, path, 1),
            (text(mixed + "!@#$%^&*", int(draw.integers(8, 20))), name, before + name + " ", after, path, 1),
            (text(mixed[:52], int(draw.integers(16, 41))), name, before + name + " ", after, path, 1),
            (text(mixed[:26], int(draw.integers(16, 41))), name, before + name + " ", after, path, 1),
            (text(mixed[26:52], int(draw.integers(20, 41))), name, before + name + " ", after, path, 1),
            (words(1, ""), name, before + name + " ", after, path, 0),
            (str(draw.choice(NOTHING)), name, before + name + " ", after, path, 0),
            (words(2, str(draw.choice([".", "_", "-", " ", "/"]))) + str(draw.choice(["", "()", "[0]", ",", ")"])), name, before + name + " ", after, path, 0),
            (str(draw.choice(["${", "{{", "<", "$", "%("])) + words(int(draw.integers(1, 3)), "_").upper() + str(draw.choice(["}", "}}", ">", "", ")s"])), name, before + name + " ", after, path, 0),
            (words(int(draw.integers(3, 6)), str(draw.choice(["-", "_", "/", "."]))), str(draw.choice(["", "name", name])), before, after, path, 0),
            (words(int(draw.integers(3, 6)), ""), "", before, after, path, 0),
            (cased(words(1, "")), str(draw.choice([other(), name])), before, after, path, 0),
            (cased(syllables(int(draw.integers(2, 5)))), other(), before, after, path, 0),
            (cased(syllables(int(draw.integers(7, 14)))), "", before, after, path, 0),
            (cased(words(int(draw.integers(4, 7)), "")), "", before, after, path, 0),
            (text(mixed[:52], int(draw.integers(24, 45))), "", before, after, path, 1),
            ("".join(w.capitalize() for w in words(int(draw.integers(3, 5)), " ").split()), "", before, after, path, 0),
            (text("0123456789", int(draw.integers(1, 4))) + str(draw.choice(["", "px", "%", "ms", ":00"])), name, before + name + " ", after, path, 0),
        ]
    return out


def grow_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Random forest: bootstrapped trees, best Gini split among a random half of the features.

    A tree is (feature, threshold, value) in heap order; feature -1 marks a leaf.
    """
    draw, out = np.random.default_rng(seed), []
    for _ in range(trees):
        feature, bound, value = np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1)), np.zeros(2 ** (depth + 1))
        nodes = {1: draw.integers(0, len(y), len(y))}
        while nodes:
            at, rows = nodes.popitem()
            value[at] = y[rows].mean()
            if at >= 2**depth or len(rows) < 2 * least or value[at] in (0.0, 1.0):
                continue
            best = (value[at] * (1 - value[at]) - 1e-9, -1, 0.0)
            for f in draw.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows, f][order], np.cumsum(y[rows][order])
                cut = np.flatnonzero(v[:-1] < v[1:]) + 1
                cut = cut[(cut >= least) & (cut <= len(rows) - least)]
                if len(cut):
                    p, q = ones[cut - 1] / cut, (ones[-1] - ones[cut - 1]) / (len(rows) - cut)
                    gini = (cut * p * (1 - p) + (len(rows) - cut) * q * (1 - q)) / len(rows)
                    k = int(np.argmin(gini))
                    if gini[k] < best[0]:
                        best = (gini[k], f, (v[cut[k] - 1] + v[cut[k]]) / 2)
            if best[1] >= 0:
                feature[at], bound[at] = best[1], best[2]
                low = x[rows, best[1]] <= best[2]
                nodes[2 * at], nodes[2 * at + 1] = rows[low], rows[~low]
        out.append((feature, bound, value))
    return out


def vote(forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, bound, value in forest:
        at = np.ones(len(x), np.int64)
        while (live := feature[at] >= 0).any():
            f = feature[at[live]]
            at[live] = 2 * at[live] + (x[live, f] > bound[at[live]])
        total += value[at]
    return total / len(forest)


def fit_secrets(findings: list[tuple[str, str, str, str, str, int]] | None = None, *, words: list[str] = WORDS, **how) -> list:
    """A forest from labelled findings, by default those of :func:`labelled_findings` (grown once in a process)."""
    if not findings:
        return _ruled(tuple(words), tuple(sorted(how.items())))
    describe = Describe(words)
    x = np.array([describe(*f[:5]) for f in findings])
    return grow_forest(x, np.array([f[5] for f in findings]), **how)


@cache
def _ruled(words: tuple[str, ...], how: tuple) -> list:
    return fit_secrets(labelled_findings(), words=list(words), **dict(how))


def scan_secrets(docs: DataFrame, forest: list, *, path: str = "source", report: float = REPORT, words: list[str] = WORDS) -> DataFrame:
    """Findings in ``docs`` (doc_id, text, and a path column): one row for each secret.

    Returns doc_id, start and end (code points, end exclusive), name (what it is
    assigned to, or empty), found_sha256 (the secret itself isn't repeated) and
    score, the forest's share of votes, at least ``report``.

    A candidate is a value of 4 or more characters after a word that names a secret
    (password, token, key ...) and a sign, "is" or a blank, up to its closing
    quote or the next blank; after a blank alone it has a digit or sign beside a
    letter, or 16 characters.  So is any other run of 16 or more of
    ``A-Za-z0-9+/_-=.``; of ``name=value`` the value.  The forest decides.

    Null or empty text: no rows.  Null path: empty.  Null doc_id: kept.  Repeated rows and repeated secrets: a row for each.  No
    rows: no rows.  Other columns are ignored.  Texts are scanned whole; no
    shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees times 2 ** depth nodes at most
    outside = bytes(set(range(256)) - set(INSIDE))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, describe = shared.value, Describe(words)
        for b in batches:
            for s in slices(b, "text"):
                x = Text(s.column("text"))
                start, end, first = x.words(outside)
                some = np.flatnonzero(end - start >= SHORTEST)
                row = np.searchsorted(first, some, "right") - 1
                rows, features = [], []
                bounds = np.searchsorted(row, np.arange(s.num_rows + 1))
                for i in np.flatnonzero(x.offsets[:-1] < x.offsets[1:]).tolist():
                    text, where = s.column("text")[i].as_py(), s.column("path")[i].as_py() or ""
                    at, base = some[bounds[i] : bounds[i + 1]], int(x.offsets[i])
                    first_byte, last_byte = start[at] - base, end[at] - base
                    if not text.isascii():  # code points before a byte
                        points = np.concatenate(([0], np.cumsum((x.bytes[base : int(x.offsets[i + 1])] & 0xC0) != 0x80)))
                        first_byte, last_byte = points[first_byte], points[last_byte]
                    for a, z, name in candidates(text, list(zip(first_byte.tolist(), last_byte.tolist(), strict=True))):
                        rows.append((i, a, z, name, text[a:z]))
                        features.append(describe(text[a:z], name, text[max(0, a - 60) : a], text[z : z + 40], where))
                if rows:
                    score = vote(trees, np.array(features))
                    keep = np.flatnonzero(score >= report)
                    ids = s.column("doc_id").take(pa.array([rows[k][0] for k in keep], pa.int64()))
                    columns = [ids, *[pa.array([rows[k][c] for k in keep], t) for c, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.string()))], pa.array(score[keep])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "name", "found", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", F.col(path).cast("string").alias("path")).mapInArrow(scan, f"doc_id {kind}, start int, end int, name string, found string, score double")
    return found.select("doc_id", "start", "end", "name", F.sha2("found", 256).alias("found_sha256"), "score")

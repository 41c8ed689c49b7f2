"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, prefix_sums

# The words of the query contracts, and signs and digits that count against a document's quality.
WORD, BETWEEN, BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"
SIGNS = "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~0123456789"


RESULT = ("doc_id", "size", "source_size", "target", "taken")


def quality_weight(text: Column, least: float = 0.05) -> Column:
    """Share of the characters that are neither signs nor digits, at least ``least``."""
    text = F.coalesce(text, F.lit(""))
    signs = "".join(c if c.isalnum() else f"\\{c}" for c in SIGNS)
    share = (F.length(text) - F.length(F.regexp_replace(text, f"[^{signs}]++", ""))) / F.length(text)
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(least), share))


def uniform(key: Column, seed: int) -> Column:
    """A number inside (0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def key_range(key: Column, per_doubling: int) -> Column:
    """The range that a key falls in, by falling key: ``per_doubling`` of them for each doubling of ``-ln(key)``."""
    fall = F.when(key > 0, F.least(F.greatest(-F.log(key), F.lit(2.0**-60)), F.lit(2.0**60))).otherwise(F.lit(2.0**60))
    return F.floor(F.log2(fall) * per_doubling).cast("int")


def source_targets(ws: Workspace, sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets per source of ``sized`` (source, size): source, source_size, target.

    Sources by code point, null last, take the weights in turn and share all
    words by weight; no target exceeds ``most`` times its source's size, and
    what that leaves over goes to the others by weight.  The end state of that
    sharing is found at once: by rising ratio of cap to weight, a source is
    capped if its cap is at most its share of what the sources before leave.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    ranked = prefix_sums(ws, per.withColumn("one", F.lit(1).cast("bigint")), [F.col("source").asc_nulls_last()], ["one"], "sources")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    capped = ranked.select("source", "source_size", pick.cast("bigint").alias("w"), (F.col("source_size") * most).alias("cap"))
    filled = prefix_sums(ws, capped, [(F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()], ["cap", "w"], "shares")
    words, weight = filled.agg(F.sum("source_size"), F.sum("w")).first()
    share = (F.lit(words or 0) - F.col("cap_before")).cast("double") / (F.lit(weight or 0) - F.col("w_before"))
    marked = filled.withColumn("full", F.col("cap") <= share * F.col("w"))
    given, used = marked.filter("full").agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    level = float((words or 0) - given) / ((weight or 0) - used) if (weight or 0) > used else 0.0
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("w"))
    return marked.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, buckets: int = 1024, payload: list[str] | None = None) -> DataFrame:
    """How many words the mix takes of every document of ``docs`` (doc_id, text, source).

    Returns doc_id, size (words), source_size, target, taken, and the columns
    named in ``payload``, but for those with the name of a result.  A source's budget is its target rounded to words.
    Complete epochs come first: every document once per epoch.  The rest goes to
    documents by falling Efraimidis-Spirakis key ``u ** (1 / weight)``, u a hash
    of doc_id and the seed, weight the document's quality; the document at the
    end of the budget gives its first words only, so sources meet their budgets
    exactly.  ``taken`` is at most ``most`` times the size.

    The prefix sums inside a source are taken in ranges of the key, ``buckets``
    for each doubling of ``-ln(key)``.  At any quality ``-ln(key)`` is exponential,
    so a range holds at most ``ln(2) / (e * buckets)`` of a source, a 4000th,
    whatever the mix of qualities, and a source of any size is spread over many tasks.

    Null or empty text: size 0, taken 0.  Null source: a source of its own, last.
    Null doc_id: as an empty id.  Equal keys: by doc_id, then size; repeated rows
    are documents of their own.  No rows: no rows.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    # one letter is left for each word, so no array of words is made; what stands at the ends is trimmed
    words = F.coalesce(F.length(F.regexp_replace(F.btrim("text", F.lit(BLANKS)), f"{BETWEEN}*+{WORD}+", "x")), F.lit(0)).cast("bigint")
    key = F.pow(uniform(F.col("doc_id"), seed), 1 / quality_weight(F.col("text")))
    sid = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))  # no nulls, so plain equality serves joins and windows alike
    extra = [c for c in payload or [] if c not in RESULT]
    sized = docs.select("doc_id", "source", sid.alias("sid"), words.alias("size"), key.alias("key"), *([F.struct(*[F.col(f"`{c}`") for c in extra]).alias("payload")] if extra else [])).withColumn("bucket", key_range(F.col("key"), buckets))
    sized = ws.keep(sized, "sized")
    targets = source_targets(ws, sized, weights, most)
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = targets.select(sid.alias("sid"), "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    per = sized.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = per.select("sid", "bucket", before.cast("bigint").alias("before")).join(plan, "sid")
    at = sized.join(ranges, ["sid", "bucket"])
    inside = Window.partitionBy("sid", "bucket").orderBy(F.col("key").desc(), F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return at.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), *[F.col("payload")[c].alias(c) for c in extra])

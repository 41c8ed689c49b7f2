"""Line dedup by distinct-site spread: sketches first, exact counts where the sketch is in doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Sites from which a line is boilerplate; log2 of the registers of a sketch.
SITES, LG_K = 10, 12
# Fixed value: white space that doesn't count at the ends of a line.
BLANKS = " \t\r\x0b\x0c"


def _lines(docs: DataFrame, site: Column) -> DataFrame:
    """Non-blank lines: document (id and hash of its text), number, hash pair, site."""
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(site, F.lit("\x00")).alias("site"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return each.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line <> ''").select("doc_id", "th", "site", "no", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"))


def spread_lines(docs: DataFrame, ws: Workspace, *, sites: int = SITES, lg_k: int = LG_K, site: str = "source") -> DataFrame:
    """Boilerplate lines (h, h2) and where the first of each stands (first: doc_id, th, no).

    Every line hash has a HyperLogLog sketch of its sites, merged by partial
    aggregation, so a line in a third of all rows is no burden.  Within three
    standard errors of the threshold the distinct sites are counted exactly.
    """
    lines = _lines(docs, F.col(site).cast("string"))
    doubt = 3 * 1.04 / (1 << lg_k) ** 0.5
    sketched = lines.groupBy("h", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("doc_id", "th", "no")).alias("first"))
    wide = sketched.select("h", "h2", "first", F.hll_sketch_estimate("sketch").alias("spread")).filter(F.col("spread") >= sites * (1 - doubt))
    wide = ws.keep(wide, "wide")
    near = wide.filter(F.col("spread") <= sites * (1 + doubt))
    exact = lines.join(near.select("h", "h2"), ["h", "h2"]).groupBy("h", "h2").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= sites)
    sure = wide.filter(F.col("spread") > sites * (1 + doubt))
    return sure.select("h", "h2", "first").unionByName(near.join(exact, ["h", "h2"]).select("h", "h2", "first"))


def dedup_lines(docs: DataFrame, *, sites: int = SITES, lg_k: int = LG_K, site: str = "source") -> DataFrame:
    """``docs`` without the repeats of lines that stand on ``sites`` or more distinct sites.

    Text loses every such line but the first (least doc_id, then place in the
    text), so one copy stays in the corpus; n_lines counts non-blank lines and
    n_removed those taken out.  Lines are compared without blanks at their ends;
    blank lines always stay; what stays is unchanged and joined by newlines.

    Null text: stays null, 0 lines.  Null site: one site of its own.  Null
    doc_id: before all others.  Repeated rows (same id and text) are treated
    alike: if they hold the first copy they all keep it.  No rows: no rows.
    Other columns stay; columns named n_lines or n_removed are replaced.
    """
    ws = Workspace(docs.sparkSession, "linededup")
    docs = docs.drop("n_lines", "n_removed")
    spread = spread_lines(docs, ws, sites=sites, lg_k=lg_k, site=site)
    again = _lines(docs, F.col(site).cast("string")).join(spread, ["h", "h2"]).filter(F.struct("doc_id", "th", "no") != F.col("first"))
    cut = again.groupBy("doc_id", "th").agg(F.collect_set("no").alias("_cut")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_cut")
    # split below the join: inlined into a lambda, the split would run again for every line
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("other"), "doc_id", F.split("text", "\n").alias("lines"), F.xxhash64("text").alias("th"))
    joined = whole.join(cut, whole["doc_id"].eqNullSafe(cut["_id"]) & (whole["th"] == cut["_th"]), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "_cut")
    left = F.when(F.col("_cut").isNull(), F.col("lines")).otherwise(F.transform(stays, lambda i: F.element_at("lines", i + 1)))
    solid = F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return joined.select(
        *[F.array_join(left, "\n").alias("text") if c == "text" else F.col("other")[c].alias(c) for c in docs.columns],
        F.when(F.col("lines").isNull(), 0).otherwise(solid).cast("bigint").alias("n_lines"),
        F.when(F.col("_cut").isNull(), 0).otherwise(F.size("_cut")).cast("bigint").alias("n_removed"),
    )

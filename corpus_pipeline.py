"""A training corpus from documents: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import Workspace, table
from lakequill.llm.decontam import contaminated, decontaminate
from lakequill.llm.linededup import dedup_lines
from lakequill.llm.mixing import mix_sources
from lakequill.llm.ngramjoin import keep_one_of_each
from lakequill.llm.toxicity import REJECT, fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled ones among them.

    All stay where there is nothing to learn from: no labelled documents, or
    toxic or clean ones only.  Null and empty texts score as the model's bias.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    if not model.usable:
        return docs
    scored = score_toxicity(docs, model)
    return scored.filter(scored["score"] < REJECT).drop("score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines lose all but their first copy; documents stay, n_chars follows the text; null texts stay null."""
    return _counted(dedup_lines(docs), docs)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars counted anew."""
    return out.selectExpr(*[f"CAST(length(text) AS {docs.schema['n_chars'].dataType.simpleString()}) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one of those without words; rows with a null doc_id stay."""
    return keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a full window (13 words) of a benchmark item go, however long they are.

    An item of fewer words may be a common phrase, so it takes a document with it
    only if hit words make up a twentieth or more; other documents lose such
    passages, n_chars follows the text, and what stands around them stays as it
    is.  Passages that only come together by a cut are not looked for.  Null and
    empty texts stay; an empty benchmark leaves all as it is.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(~(F.col("whole_window") | contaminated()))
    before = "coalesce(get(hits, i - 1).end, 0)"
    rest = f"array_join(transform(sequence(0, size(hits)), i -> substring(text, {before} + 1, coalesce(get(hits, i).start, length(text)) - {before})), '')"
    found = found.withColumn("text", F.when(F.size("hits") > 0, F.expr(rest)).otherwise(F.col("text")))
    return _counted(found, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each (repeats counted); texts without words are not taken."""
    out = mix_sources(docs, payload=["text", "lang", "source", "n_chars"])
    return out.filter("taken > 0").select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL can't say what the first stage's model rejects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            ws.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

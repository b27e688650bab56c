"""Documents to a token store in five stages, each of which works on all that the one before it kept.

quality rules       rejected documents go: those that fail the base rule, and those of rejected hosts
near duplicates     one document of each component of the n-gram Jaccard join stays
decontamination     documents with benchmark windows in a twentieth of their words or more go
mixing              documents are repeated, or left out, until sources stand at their targets; all are taken whole, the
                    last ones of a source being those that fit best
token ids           the mix is encoded and written as a token store, and the result is read from its files

A stage's result is written to the shared folder and read again as the next one's documents, and deleted once that has
been written too.  All stages but the last return the columns of documents, whatever else these hold.

Defined results: a document without words (null, empty or blank text) goes with the base rule.  Of rows alike in doc_id
and text the near duplicates keep one; of a component the smallest doc_id, null first; documents of equal doc_id and
different texts are documents of their own.  A null source is a host and a source like any, the last one in the
weights.  Extra columns, whatever their names, pass through all stages but the last.  An empty table gives no rows,
and with an empty benchmark nothing is contaminated.  Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arboria.llm import common, decontaminate, mixing, ngram_join, quality, token_store

#: The tokenizer, the near-duplicate closure and the drawn repetitions have no SQL; a brute-force test stands for it.
ORACLE_SQL = None


def _carried(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # texts are measured twice, as a table of annotated rows would hold them all once more until the pipeline's end
    rates = quality.host_rates(quality.annotated(docs))
    rejected = rates.where(F.col("host_rate") > quality.HOST_RATE).select(F.col("host").alias("bad"))
    rows = quality.annotated(docs, carry=_carried(docs))
    return rows.where(~F.col("base_failed")).join(rejected, F.col("host").eqNullSafe(F.col("bad")), "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), carry=_carried(docs))
    return judged.where(~F.col("contaminated")).select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.mix_whole(docs, carry=_carried(docs)).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.token_store(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixed_sources),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents of sf_dir."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        done = common.new_dir(spark, "stage")
        with common.scratch(spark), common.freed(spark):
            stage(spark, docs, sf_dir).write.parquet(done)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(done), done
    return STAGES[-1][1](spark, docs, sf_dir)

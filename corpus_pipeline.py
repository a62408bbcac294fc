"""A training-corpus pipeline over the documents table: toxicity, near-duplicates, decontamination, secrets, mixing.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever other columns docs has, also ones named as
an operator's results. Rows with a null doc_id, and repeated rows, are rows of their own in every stage; an empty table stays empty.
Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import decontam, minhash, mixing, secret_scan, toxicity
from quillframe.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects, with a score of 0.5 or more, go.

    Null and empty texts are scored as texts without words. Rows with a null doc_id have no label and are scored all the same.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Null and empty texts are near nothing and stay. Rows with a null doc_id stay, as no smallest doc_id can be told for them; rows that
    share a doc_id stay or go together.
    """
    gone = stored(minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "stage-gone")
    few = gone.count() <= minhash.BROADCAST_JOBS  # ids of 8 bytes; more of them are joined by a shuffle
    return docs.select(*COLUMNS).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; rows with a null doc_id are searched as any other.
    """
    return decontam.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows where the text changed, else it stays as it was, null too.

    Null texts stay null; one row comes out for each that goes in.
    """
    found = secret_scan.scan(docs.select(*COLUMNS), secret_scan.train(secret_scan.labelled_findings(spark)))
    chars = F.when(F.col("clean_text") == F.col("text"), F.col("n_chars")).otherwise(F.length("clean_text"))
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", chars.cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix of sources to the shared folder and returns how many words of each document it holds.

    One row for each that goes in; null and empty texts have size 0 and give nothing, null sources are one source.
    """
    return mixing.mix_sources(docs)[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix),
]

#: Trees, alignments and draws by hash are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from documents: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

A stage works on all that its predecessor kept, written as Parquet and read again. All but the last return the
columns of documents. Extra columns are dropped by the first stage; an empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from levelstream.llm import mixing, piece_codes, simhash, substring_dedup, toxicity
from levelstream.llm.shared import discard, materialize, row_key, scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score THRESHOLD or more; the network learns from the labelled rows of the stage's input.

    Null text scores like an empty one; repeated rows score alike and go or stay together.
    """
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), net).where(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest doc_id, and of its texts the least by hash.

    Rows without a doc_id come after all others; rows that repeat a doc_id and its text are one.
    """
    rows = docs.select(*COLUMNS, *row_key())
    found = simhash.near_duplicates(rows, ("doc_id", "row_doc", "row_hash"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "row_doc", "row_hash")).alias("best")
    kept = materialize(found.groupBy("root").agg(best).select("best.row_doc", "best.row_hash"), "kept")
    return rows.join(kept, ["row_doc", "row_hash"], "left_semi").dropDuplicates(["row_doc", "row_hash"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that also start elsewhere go from every text; no document does.

    A character that is cut in two stays. Null text becomes empty; repeated rows and equal texts empty each other.
    """
    cut = substring_dedup.remove_repeats(docs, ("doc_id", "lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy that the mix takes of a document, and one for the words it takes beyond.

    The latter holds these words with the white space between them. Repeated rows and rows without a doc_id are
    mixed like any other; a text without words is not taken.
    """
    rows = mixing.mixed_texts(docs, ("doc_id", "lang", "source"))
    return rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the proof that they decode to it.

    The texts that the mix takes of one document are numbered, longest first and then by text, so that its copies
    differ in the merges they skip. Rows without a doc_id are numbered by text; null text has no pieces.
    """
    same = Window.partitionBy(F.coalesce("doc_id", F.xxhash64("text"))).orderBy(F.col("n_chars").desc(), "text")
    return piece_codes.encode_documents(docs.withColumn("copy", F.row_number().over(same)), piece_codes.piece_bpe, copy="copy")


STAGES = [
    ("toxicity", toxic),
    ("simhash", near_copies),
    ("substring_dedup", repeats),
    ("mixing", mixed),
    ("piece_codes", pieces),
]

#: SQL has no trained network and no merge dropout.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the whole documents; the tables of a stage, and its input, are deleted when its result is written."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as own:
            docs, last = own.keep(materialize(stage(spark, docs, sf_dir), name)), made
        if last is not None:
            discard(last)
        made = docs
    return STAGES[-1][1](spark, docs, sf_dir)

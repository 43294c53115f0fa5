"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of documents, with columns of any other name as
they were. An empty table gives an empty one in each of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.llm import line_dedup, near_dedup, packing, secrets, toxicity
from barlab.llm.session import documents, ensure_checkpoint_dir


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for toxic go.

    A null or empty text has no evidence against it; rows are judged one by
    one, repeated ones alike. Without toxic labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = toxicity.toxicity(docs, labels, held_out=held_out, score_col="__score", predicted_col="__toxic")
    return scored.where("__toxic = 0").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites go from all documents but one; no document goes.

    Null texts stay null; a line found under null ids only goes from all of
    them; repeated rows are treated alike.
    """
    return _measured(line_dedup.remove_boilerplate(docs, report=None))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; five words a shingle, a similarity of 0.8.

    It is the one with the smallest id, a null id coming last. What goes is a
    row, by its id and text: another text under the same id is another
    document. Of rows that repeat both, one stays. Documents without words are
    in no group and all stay.
    """
    found = near_dedup.near_duplicates(docs, sketch=near_dedup.Sketch(width=5, percent=80, bands=32, rows=5))
    texts = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    fate = texts.agg(F.max("first").alias("__stays"), F.count(F.lit(1)).alias("__times")).where("NOT __stays OR __times > 1")
    keyed = docs.withColumn("__h", F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(fate, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left").where("__stays IS NULL OR __stays")
    once = joined.where("__times IS NULL").select(*docs.columns)
    repeated = joined.where("__times IS NOT NULL").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return once.union(repeated)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are masked, widely copied examples stay; no document goes.

    Null texts stay null; repeated rows are treated alike.
    """
    return _measured(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens with the corpus' mixture of sources in each: a row for each piece of a document.

    A null or empty text is a document of the end id alone; repeated rows and
    ids are documents like any other.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between them is written beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""A corpus from raw documents to packed sequences: five stages, each on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to ``documents``, writing each
stage's rows to the shared folder and reading them again for the next, so a lost executor costs one stage at most.

The mix writes its rows in training order: the files that it leaves follow each other, and packing takes that order from
them, so sequences come in the order of the curriculum, by ``STEPS`` steps of about equal length.

Defined results, for every stage: an empty table gives an empty one; columns of ``documents`` alone are carried on, others of
any name are dropped; rows that repeat are treated each by itself but for near-duplicates, where one row stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm import langid, mixture, packing, secrets, simhash
from touchline.llm.common import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text goes if its language can't be told or its best language has less than this share of the likelihood.
LEAST_SCORE = 0.3
#: Steps of the training order that packing keeps apart.
STEPS = 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told; a missing label is filled in with it. Null, empty and letterless texts go, as their
    language can't be told; without any labelled row every text goes. A null id, source or n_chars stays as it is."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.filter(~langid.held_out()))
    told = langid.predict(docs, model, lang_as="__lang", score_as="__score").filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "__lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group; null and blank texts are one group, a row without an id stays only
    where its group has no other."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document; secrets in its text give way to a mark. A null text stays null; null sources are one owner."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order. Null and blank texts have no words, so the mix takes none of them;
    documents without a source are a source of their own."""
    out = mixture.emit(mixture.mix(docs.select(*COLUMNS))).withColumn("n_chars", F.length("text").cast("long"))
    return out.repartitionByRange("position", "doc_id", "__copy").sortWithinPartitions("position", "doc_id", "__copy").select(*COLUMNS)


def steps(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__step``, the part of the training order that its file belongs to: files in the order of their names, by
    their characters. Rows that come from no file are one step."""
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("__file"))
    except AnalysisException:
        return docs.select(*COLUMNS, F.lit(0).alias("__step"))
    # one row per file meets in one task
    files = placed.groupBy("__file").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    upto = F.sum("chars").over(Window.orderBy("__file")) - F.col("chars")
    whole = F.greatest(F.lit(1), F.sum("chars").over(Window.partitionBy()))
    step = F.least(F.lit(STEPS - 1), F.floor(upto * STEPS / whole)).cast("int")
    return placed.join(files.select("__file", step.alias("__step")), "__file").drop("__file")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, the sequences of an earlier step of the training order first. A null text is empty and
    has the end id alone; copies of a document are told apart by ``row_id``."""
    return packing.pack_documents(steps(docs), step_col="__step")


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scan), ("mixing", mix), ("packing", pack)]
#: SQL can't express the learnt language model, XXH64 fingerprints or byte-pair tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Corpus pipeline: language ID, near-dedup, sanitisation, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last keep
the columns of ``documents``. A null or odd value in any column is handled as
the stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import shared_path
from pagelens.llm.langid import UNKNOWN, predict, train, training_rows
from pagelens.llm.minhash import drop_near_duplicates
from pagelens.llm.mixing import ADDED, mix_sources
from pagelens.llm.packing import pack_documents
from pagelens.llm.pii import sanitize
from pagelens.llm.tokens import default_path

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter go."""
    columns = docs.columns
    model = train(training_rows(docs).select("text", "lang"))
    return predict(docs, model).filter(F.col("lang_pred") != UNKNOWN).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced and disclosing terms removed or generalised; ``n_chars`` follows the text."""
    clean = sanitize(docs)
    if "n_chars" not in clean.columns:
        return clean
    kind = clean.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    return mix_sources(docs).drop(*ADDED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: sequence_id, used, input_ids (little-endian), doc_ids in order and their pieces."""
    packed = pack_documents(docs, default_path(TOKENIZER))
    return packed.select("sequence_id", "used", "input_ids", F.transform("pieces", lambda p: p.doc_id).alias("doc_ids"), "pieces")


STAGES = [("language_id", language), ("minhash_dedup", near_dedup), ("pii", pii), ("mix_sources", mix), ("packing", pack)]

#: Language vectors, b-bit signatures and token ids have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

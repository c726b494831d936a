"""A corpus pipeline: each stage reads what the one before kept, and all but the last return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .decontaminate import decontaminated
from .langid import UNKNOWN, identify, train_model
from .linededup import remove_repeated_chunks
from .packing import pack_documents
from .queries import vocabulary
from .simhash import one_of_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has a smaller mean probability isn't in any language known.
LEAST_LANGUAGE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no known language: those without letters (null and empty ones too), and those that the network can't tell at all.

    Ids play no part: rows with null or repeated ids and repeated rows each stay or go by their text. Without any labelled
    text there is no known language, and nothing stays. Only COLUMNS are returned; an empty table gives no rows.
    """
    told = identify(docs.select(*COLUMNS), train_model(docs), "text", tuple(COLUMNS))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of two lines or more; a document of which nothing is left goes.

    A passage's place in the smallest id stays; null ids come first, and rows that repeat id and text are one place. Null and empty
    texts stay as they are. n_chars is counted anew. Only COLUMNS are returned; an empty table gives no rows.
    """
    kept = remove_repeated_chunks(docs.select(*COLUMNS), pairs=True)
    kept = kept.where((F.col("removed_lines") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates, by op2's fingerprints and links: that with the smallest id, as one_of_near_duplicates() says.

    Rows are told apart by id and text: two unlike texts of one id both stay, a repeated row stays once, rows with null
    ids are compared like others and stay only if their component has no id. All texts without words are one component.
    Only COLUMNS are returned; an empty table gives no rows.
    """
    return one_of_near_duplicates(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item.

    Every row is judged by its own text: one with a null id goes like others, and of rows that share an id only those that
    hold a passage go; repeated rows go or stay together. Null and empty texts stay. Only COLUMNS are returned; an empty table gives no rows.
    """
    return decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences: pack_documents() says what becomes of null, empty and repeated rows."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("language id", language_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Networks, fingerprints and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs

"""Entities and relations out of model answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from .. import models
from ..functions.jsonfix import mend
from ..functions.text import clamp, confidence, empty_if_null, entity_name, strip

# Delimiters of the extraction format.
RECORD, FIELD, STOP = "##", "<|#|>", "<|COMPLETE|>"
LEAST_CONFIDENCE = 0.3


def records(answers: DataFrame, id_col: str = "chunk_id", text_col: str = "answer") -> DataFrame:
    """chunk_id, seq, fields of each record; one that holds the stop marker is left out whole."""
    bare = lambda record: F.regexp_replace(strip(record), r"^\(+|\)+$", "")
    read = lambda record: F.transform(F.split(bare(record), f"\\Q{FIELD}\\E"), lambda f: F.regexp_replace(strip(f), '^["\']+|["\']+$', ""))
    # Fields are read before records are parted, so once, however many columns come of them.
    parts = F.transform(F.split(empty_if_null(F.col(text_col)), f"\\Q{RECORD}\\E"), lambda record: F.when(~record.contains(STOP), read(record)))
    return answers.select(F.col(id_col).alias("chunk_id"), F.posexplode(parts).alias("seq", "fields")).where("fields is not null")


def entities(answers: DataFrame, least: float = LEAST_CONFIDENCE, id_col: str = "chunk_id", text_col: str = "answer") -> DataFrame:
    """chunk_id, seq, name, type, description, confidence: of a name's records in a chunk the last counts."""
    f = lambda i: F.get("fields", F.lit(i))
    rows = records(answers, id_col, text_col).where((F.lower(f(0)) == "entity") & (F.size("fields") >= 5))
    rows = rows.select("chunk_id", "seq", entity_name(f(1)).alias("name"), f(2).alias("type"), f(3).alias("description"), confidence(f(4)).alias("confidence"))
    last = rows.where("name <> ''").groupBy("chunk_id", "name").agg(F.max_by(F.struct("seq", "type", "description", "confidence"), "seq").alias("r"))
    return last.select("chunk_id", "r.seq", "name", "r.type", "r.description", "r.confidence").where(F.col("confidence") >= least)


def relations(answers: DataFrame, least: float = LEAST_CONFIDENCE, id_col: str = "chunk_id", text_col: str = "answer") -> DataFrame:
    """chunk_id, seq, src_id, tgt_id, keywords, description, confidence, valid_from, valid_to; bad bounds are open and flagged."""
    f = lambda i: F.get("fields", F.lit(i))
    rows = records(answers, id_col, text_col).where((F.lower(f(0)) == "relationship") & (F.size("fields") >= 6))
    bound = lambda i: F.try_to_timestamp(F.nullif(f(i), F.lit("")))
    bad = F.coalesce((f(6) != "") & bound(6).isNull(), F.lit(False)) | F.coalesce((f(7) != "") & bound(7).isNull(), F.lit(False))
    rows = rows.select("chunk_id", "seq", entity_name(f(1)).alias("src_id"), entity_name(f(2)).alias("tgt_id"), f(3).alias("keywords"), f(4).alias("description"), confidence(f(5)).alias("confidence"), bound(6).alias("valid_from"), bound(7).alias("valid_to"), bad.alias("bad_bound"))
    return rows.where((F.col("src_id") != "") & (F.col("tgt_id") != "") & (F.col("confidence") >= least))


@F.pandas_udf(StringType())
def _mended(texts: pd.Series) -> pd.Series:
    return texts.map(mend, na_action="ignore").astype(object)


def parse_json(text, schema: DataType | str):
    """The JSON object or array in an answer, read by the schema; null where none begins.

    What stands between the outermost brackets is read as it is if it is valid; only other answers are mended, in Arrow batches.
    """
    body = empty_if_null(text)
    inner = F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1)
    valid = F.try_parse_json(inner).isNotNull()
    fixed = _mended(F.when(~valid & body.rlike(r"[\[{]"), body))
    return F.from_json(F.when(valid, inner).otherwise(fixed), schema)


def extract(chunks: DataFrame, prompt: str, model: models.Model | None = None, gleanings: int = 0, continue_prompt: str = "MANY ENTITIES WERE MISSED", id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """chunk_id, answer: a model's answer for each chunk, with `gleanings` more passes joined to it until one stops."""
    rows = chunks.select(F.col(id_col).alias("chunk_id"), models.complete(F.concat(F.lit(prompt + "\n"), F.col(text_col)), model).alias("answer"))
    for _ in range(gleanings):
        more = models.complete(F.concat(F.lit(prompt + "\n"), F.col("answer"), F.lit(f"\n{continue_prompt}")), model)
        rows = rows.select("chunk_id", F.when(F.col("answer").contains(STOP), F.col("answer")).otherwise(F.concat("answer", F.lit(RECORD), more)).alias("answer"))
    return rows


def keep_confident(rows: DataFrame, least: float = LEAST_CONFIDENCE, col: str = "confidence") -> DataFrame:
    return rows.withColumn(col, clamp(F.coalesce(F.col(col).cast("double"), F.lit(0.5)))).where(F.col(col) >= least)

"""Lexical search by stems, ranked by how near a question's terms stand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.stems import stem
from ..functions.text import lexical_tokens
from ..plans.durable import stored
from .lexical import PLACES


def stems(word: Column, language: str = "en") -> Column:
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stem(w, language), na_action="ignore").astype(object)

    run.__annotations__ = {"words": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(word)


def cover_density(places: list[int], terms: list[int], n: int) -> float:
    """The sum over the shortest stretches that hold all n terms of n / (words in the stretch): 1 where they stand side by side.

    places are sorted; a stretch is one that holds no shorter one with all terms.
    """
    last, total, began = [-1] * n, 0.0, -1
    for place, term in zip(places, terms):
        last[term] = place
        first = min(last)
        # A stretch that begins where the one before began isn't the shortest.
        if first >= 0 and first > began:
            total += n / (place - first + 1)
            began = first
    return total


def stemmed_search(docs: DataFrame, queries: DataFrame, k: int | None = 10, language: str = "en", id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text_col: str = "text") -> DataFrame:
    """query_id, rank, id, score of the k best documents (all without k) that hold every stem of a question, by cover density, ties to the smaller id.

    Each different word of the documents is stemmed once. The documents that hold a question's two rarest stems are found first; positions are taken of these documents only, and of their
    words with a question's stem. What is gathered of a document for a question is its own places, so a group is no larger than a document. Questions without tokens find nothing.
    """
    asked = queries.select(F.col(query_col).alias("query_id"), F.explode(F.array_distinct(lexical_tokens(F.col(query_text_col)))).alias("word"))
    asked = asked.select("query_id", stems(F.col("word"), language).alias("stem")).distinct()
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("stem")) - 1
    asked = stored(asked.withColumn("term", number).withColumn("n", F.count("*").over(Window.partitionBy("query_id"))))
    each = docs.select(F.col(id_col).alias("id"), lexical_tokens(F.col(text_col)).alias("toks"))
    distinct = each.select("id", F.explode(F.array_distinct("toks")).alias("word"))
    words = distinct.groupBy("word").agg(F.count("*").alias("docs")).select("word", stems(F.col("word"), language).alias("stem"), "docs")
    words = stored(words.join(asked.select("stem").distinct(), "stem", "left_semi"))
    # A stem that no document has is the rarest of all.
    counts = asked.join(words.groupBy("stem").agg(F.sum("docs").alias("docs")), "stem", "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("docs", F.lit(0)), "stem"))
    rare = stored(counts.withColumn("place", place).where("place <= 2").select("query_id", "stem", "n").join(words.select("word", "stem"), "stem"))
    both = distinct.join(rare, "word").groupBy("query_id", "id", "n").agg(F.countDistinct("stem").alias("held")).where(F.col("held") == F.least("n", F.lit(2)))
    both = stored(both.select("query_id", "id"))
    placed = each.join(stored(both.select("id").distinct()), "id", "left_semi").select("id", F.posexplode("toks").alias("pos", "word")).join(words.select("word", "stem"), "word").select("id", "pos", "stem")
    met = both.join(asked, "query_id").join(placed, ["id", "stem"]).groupBy("query_id", "id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("at"), F.countDistinct("term").alias("held")).where("held = n")

    def run(places: pd.Series, terms: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([cover_density(list(p), list(t), c) for p, t, c in zip(places, terms, n)], dtype="float64")

    run.__annotations__ = {"places": pd.Series, "terms": pd.Series, "n": pd.Series, "return": pd.Series}
    rated = met.select("query_id", "id", F.round(F.pandas_udf(run, DoubleType())("at.pos", "at.term", "n"), PLACES).alias("score"))
    rows = rated.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return (rows if k is None else rows.where(F.col("rank") <= k)).select("query_id", "rank", "id", "score")

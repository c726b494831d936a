"""Ranking lists together, reranking, and fitting contexts into token budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import models

RRF_K = 60
PLACES = 9
ENTITY_TOKENS, RELATION_TOKENS, TOTAL_TOKENS = 4000, 4000, 12000
#: Order of kinds in a context.
KINDS = ["entity", "relation", "chunk", "community"]


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """query_id, rank, id, rrf_score of ranked lists (query_id, rank from 1, id).

    An id scores 1 / (k + rank) in each list; equal sums go by the first list and
    rank that had the id.
    """
    each = [x.select("query_id", "id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, each)
    one = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), PLACES).alias("rrf_score"), F.min(F.struct("list", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first"))
    return one.select("query_id", rank.alias("rank"), "id", "rrf_score")


def rerank(rows: DataFrame, scorer: models.Scorer | None = None, k: int | None = None, query_col: str = "query", text_col: str = "content") -> DataFrame:
    """rows of a query by a scorer's score, highest first, then as they were (rank)."""
    scored = rows.withColumn("rerank_score", F.round(models.score(F.col(query_col), F.col(text_col), scorer), PLACES))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    out = scored.withColumn("rank", place)
    return out if k is None else out.where(F.col("rank") <= k)


def best_piece(scored: DataFrame, by: list[str] = ("query_id", "orig_idx"), score: str = "rerank_score") -> DataFrame:
    """The highest score of a document's pieces."""
    return scored.groupBy(*by).agg(F.max(score).alias(score))


def within_budget(rows: DataFrame, most: int | Column, by: list[str] = ("query_id",), order: list[str | Column] = ("pos",), tokens: str = "tokens") -> DataFrame:
    """The longest prefix of each group whose tokens fit; what comes after the first that doesn't is out."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(run)).where(F.col("used") <= most)


def fit_context(rows: DataFrame, entity_tokens: int = ENTITY_TOKENS, relation_tokens: int = RELATION_TOKENS, total_tokens: int = TOTAL_TOKENS) -> DataFrame:
    """rows (query_id, kind, rank, id, content, tokens): entities and relations in budgets of their own, then all, kinds in order, in one."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    limit = F.when(F.col("kind") == "entity", entity_tokens).when(F.col("kind") == "relation", relation_tokens)
    own = F.sum("tokens").over(Window.partitionBy("query_id", "kind").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("kind_pos", place).withColumn("kind_used", own).where(limit.isNull() | (F.col("kind_used") <= limit))
    return within_budget(kept, total_tokens, order=["kind_pos", "rank"]).drop("kind_used")


def references(rows: DataFrame, order: list[str | Column] = ("kind_pos", "rank")) -> DataFrame:
    """rows with ref_id: ref-1, ref-2 and so on a query."""
    return rows.withColumn("ref_id", F.concat(F.lit("ref-"), F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("string")))


def ordered_union(first: DataFrame, second: DataFrame, by: list[str] = ("query_id", "kind", "id")) -> DataFrame:
    """Both contexts, first before second, each item at its first place; ranks are numbered again."""
    rows = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)), allowMissingColumns=True)
    seen = F.row_number().over(Window.partitionBy(*by).orderBy("side", "rank"))
    rows = rows.withColumn("seen", seen).where("seen = 1").drop("seen")
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("side", "rank"))
    return rows.withColumn("place", rank).drop("rank", "side").withColumnRenamed("place", "rank")
